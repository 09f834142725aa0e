"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block-level tags. The first pass decides what a block says on its
own: menus, forms and other parts that their tags or class names give away are out, blocks full of
links are out, long blocks with many stop words are in, long ones without are out. Short blocks, and
long ones of an article whose words no stop-word list knows, stay undecided. The second pass gives
each of those the label of its nearest decided neighbour; the edges of an article count as decided
neighbours that are in, the edges of the page as ones that are out.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bindwell.llm.text import map_texts

#: Frequent function words of the languages that pages are expected in.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their there they this to was we were which will with you",
    "de": "als auch auf aus bei das dem den der des die ein eine einer er es für hat ich im in ist mit nicht sich sie sind und von war was werden wie wird zu zum zur",
    "fr": "a au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous",
    "es": "a al como con de del el en es esta este fue ha la las le lo los más no o para pero por que se ser si sin sobre son su sus un una y ya",
}
#: Tags that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page, and elements whose content is never part of an article.
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas")
OUTSIDE_TAGS = frozenset("nav footer aside form head title button select menu dialog option".split())
#: Words in class, id or role that name such parts too.
OUTSIDE_NAMES = frozenset(
    "ad ads adbox alert advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus disclaimer "
    "dropdown footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion recommended related replies "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
#: Words that make such a name one of the page's layout ("no-sidebar", "content-with-ads").
LAYOUT_NAMES = frozenset("no has with without free main content article post body entry page wrapper layout story".split())
#: Tags without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same group closes, as end tags may be left out.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
HOME_TAGS = frozenset(("article", "main"))

# possessive: an attribute's quotes are read once, whatever follows
_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW_TAGS)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_ATTRIBUTES})(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:until|false))|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class BlockRules:
    """Limits of the first pass: characters of a short and of a long block, shares of stop words and of linked characters."""

    short: int = 70
    long: int = 200
    some_stops: float = 0.2
    many_stops: float = 0.3
    links: float = 0.4
    stops: frozenset = field(default_factory=lambda: frozenset(w for words in STOP_WORDS.values() for w in words.split()))


@dataclass
class Block:
    """Text of a block, its linked characters, and where it stands."""

    text: str
    linked: int
    outside: bool
    home: int
    heading: bool


def named_outside(attributes: str, whole: bool = False) -> bool:
    """Whether a name in class, id or role, or with ``whole`` not a part of one, says that this is not the article."""
    for m in _NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = {name.lower()} if whole else {part.lower() for part in _PART.split(name)}
            if parts & OUTSIDE_NAMES and not parts & LAYOUT_NAMES:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; ``home`` numbers the article a block stands in, 0 for none."""
    found: list[Block] = []
    words: list[str] = []
    linked = homes = 0
    open_tags: list[tuple[str, bool, int]] = []  # tag, outside, home
    heading = False

    def end_block() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                found.append(Block(text, linked, open_tags[-1][1] if open_tags else False, open_tags[-1][2] if open_tags else 0, heading))
            words.clear()
        linked = 0

    def close(tag: str) -> None:
        """End the innermost open ``tag`` and what is open in it."""
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] == tag:
                del open_tags[k:]
                return

    def said(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            words.append(text)
            if in_link:
                linked += len("".join(text.split()))

    at, in_link = 0, False
    for m in _TOKEN.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not m["end"]
            continue
        if tag == "br":
            words.append(" ")
            continue
        attributes = m["attrs"]
        if tag not in BLOCK_TAGS:
            # only inline parts that hide or name themselves matter
            if m["end"]:
                if open_tags and any(t == tag for t, _, _ in open_tags):
                    end_block()
                    close(tag)
            elif attributes and tag not in VOID_TAGS and (named_outside(attributes) or _HIDDEN.search(attributes)):
                end_block()
                open_tags.append((tag, True, open_tags[-1][2] if open_tags else 0))
            continue
        end_block()
        in_link = heading = False
        if open_tags and open_tags[-1][0] == "p":
            open_tags.pop()
        if m["end"]:
            close(tag)
            continue
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in VOID_TAGS or tag == "p" and not attributes:
            continue
        for other in CLOSES.get(tag, ()):
            if open_tags and open_tags[-1][0] == other:
                open_tags.pop()
        outside, home = (open_tags[-1][1], open_tags[-1][2]) if open_tags else (False, 0)
        if tag in HOME_TAGS and not outside and not home:
            homes += 1
            home = homes
        named = bool(attributes) and tag not in ("body", "main") and (named_outside(attributes, tag in HOME_TAGS) or bool(_HIDDEN.search(attributes)))
        open_tags.append((tag, outside or named or tag in OUTSIDE_TAGS or (tag == "header" and not home), home))
    said(page[at:])
    end_block()
    return found


def first_pass(block: Block, rules: BlockRules) -> bool | None:
    """In (true), out (false) or undecided, by what the block says on its own."""
    size = len(block.text)
    if block.outside or block.linked > rules.links * size:
        return False
    if block.heading or size < rules.short:
        return None
    words = _LETTERS.findall(block.text.lower())
    share = sum(w in rules.stops for w in words) / len(words) if words else 0.0
    if share >= rules.many_stops and size >= rules.long:
        return True
    if share >= rules.some_stops or block.home:
        return True if block.home and share >= rules.some_stops else None
    return False if size >= rules.long else None


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbour of their article, or of their page outside one."""
    n = len(found)
    before: list[tuple[int, bool]] = []  # distance and label of the neighbour that decides from the front
    last, home = (-1, False), 0
    for k, (block, label) in enumerate(zip(found, labels, strict=True)):
        if block.home != home:
            last, home = (k - 1, bool(block.home)), block.home
        if label is not None and not (block.home and block.outside):
            last = (k, label)
        before.append((k - last[0], last[1]))
    result = [bool(label) for label in labels]
    last, home = (n, False), 0
    for k in range(n - 1, -1, -1):
        block = found[k]
        if block.home != home:
            last, home = (k + 1, bool(block.home)), block.home
        if labels[k] is not None:
            if not (block.home and block.outside):
                last = (k, bool(labels[k]))
            continue
        ahead = (last[0] - k, last[1])
        # at the same distance a heading belongs to what follows, any other block to what is in
        near = min(before[k], ahead, key=lambda x: x[0])
        result[k] = near[1] if before[k][0] != ahead[0] else (ahead[1] if block.heading else before[k][1] or ahead[1])
    return result


def main_text(page: str, rules: BlockRules) -> tuple[str, int, int]:
    """The page's main text, its blocks and how many of them are in it."""
    found = blocks(page)
    kept = second_pass(found, [first_pass(b, rules) for b in found])
    lines = [b.text for b, keep in zip(found, kept, strict=True) if keep]
    return "\n".join(lines), len(found), len(lines)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: BlockRules | None = None) -> DataFrame:
    """The main text of each page: ``id_col``, ``url_col``, ``text``, ``n_chars`` (code points), ``n_blocks``, ``n_kept``.

    Character references are decoded, white space inside a block is one space, blocks are joined by a
    line feed in the order of the page. A null or empty page has an empty text; broken and unclosed
    markup is read as far as it goes; rows are independent, so repeated rows give repeated results;
    an empty table gives an empty result. Pages are read whole, one at a time. Other columns are not read.
    """
    rules = rules or BlockRules()
    schema = T.StructType([
        T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType()),
    ])

    def run(batch):
        done = [main_text(x.as_py() or "", rules) for x in batch.column(2)]
        columns = [pa.array([d[0] for d in done], pa.string()), *(pa.array(x, pa.int64()) for x in ([len(d[0]) for d in done], [d[1] for d in done], [d[2] for d in done]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return map_texts(pages, [id_col, url_col, html_col], run, schema)
