"""Phrase mining, main text of pages and periodic runs, against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindwell.llm import phrases, queries, runs
from bindwell.llm.bloom import Bloom
from bindwell.llm.html_text import BlockRules, blocks, extract_text, main_text
from bindwell.llm.phrases import mine_phrases
from bindwell.llm.runs import find_runs, runs_of_slice
from bindwell.llm.text import SPACED, Words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n long, phrase string, h1 string, word string, part string, runs string, collapsed string, length string"


def table(spark, rows):
    """(id, text, lang) with columns whose names the operators use."""
    return spark.createDataFrame([(*r, 1, *["x"] * 7) for r in rows], DOCS)


# phrases


def mined(rows, least=10, top=2000, pct=50, longest=3):
    low = {k: k + 32 for k in range(65, 91)}
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if longer[p] and 100 * longer[p] >= pct * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def chatter(seed):
    rng = random.Random(seed)
    said = []
    for k in range(150):
        words = [rng.choice(["new", "york", "city", "new york", "New York City", "a", "b", "été", "x y"]) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "\r", "\x0b"]) for _ in range(rng.randrange(0, 60))]
        said.append((k, "".join(words), rng.choice(["en", "en", "fr", None])))
    return [*said, (7, None, "en"), (8, "", None), (9, " \t.,", "fr"), *said[:5], (None, "new york city " * 3000, "en")]


def test_phrases(spark):
    rows = chatter(1)
    got = sorted(map(tuple, mine_phrases(table(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == mined(rows) and len(got) > 20
    for options in ({"top": 3, "least": 20}, {"longest": 2}, {"longest": 4, "least": 15, "subsumed_pct": 90}):
        got = sorted(map(tuple, mine_phrases(table(spark, rows), **options).collect()))
        names = {"subsumed_pct": "pct"}
        assert got == mined(rows, **{names.get(k, k): v for k, v in options.items()})


def test_phrases_of_empty_tables_and_hot_prefixes(spark, monkeypatch):
    assert mine_phrases(table(spark, [(1, "a", "en")]).limit(0)).count() == 0
    assert mine_phrases(table(spark, [(1, None, None), (2, "one two", "en")])).count() == 0
    rows = [(k, " ".join(f"the w{(k * 7 + j) % 40}" for j in range(40)), "en") for k in range(30)]
    for hot in (1, 4096):
        monkeypatch.setattr(phrases, "HOT", hot)
        assert sorted(map(tuple, mine_phrases(table(spark, rows)).collect())) == mined(rows)


def test_large_counts_are_exact(spark):
    f = 3_000_000_019
    level = spark.createDataFrame([("en", [1], f), ("en", [2], f + 8), ("en", [1, 2], f - 1)], "lang string, phrase array<long>, f long")
    row = phrases._scored(level, level.where("size(phrase) = 2").withColumnRenamed("f", "a")).first()
    assert row["score"] == 1_000_000 * (f - 1) ** 2 // (f * (f + 8))


def test_bloom_never_says_no(spark):
    keys = spark.range(3000).select((F.col("id") * 7919).alias("key"))
    for most in (1 << 16, 1 << 28):
        found = Bloom.of(keys, bits_per_key=16, max_bits=most)
        assert found.has((np.arange(3000) * 7919).astype(np.uint64)).all()
        assert found.has(np.arange(1, 2000).astype(np.uint64)).mean() < 0.3
        found.destroy()


# pages

PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{x:1}</style><script>var t="</p><p>not text";</script></head><body class="no-sidebar">
<header><h1>Site name</h1><p>The best of the news in the world and of all that is in it for you to read.</p></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><!-- <p>comment</p> -->
<div class="cookie-notice">We use cookies to make the site better for you and for all of the others who are here with us on this page.</div>
<article class="post"><h2>A&nbsp;headline &lt;here&gt;</h2><p>Short one.<p>The <b>first</b> paragraph of the story is about the man who was with his dog in the house, and it is
 long enough to be sure of, as it has more than two hundred characters and many of the words that are on the list for English.<br>Next line.
<figure><img src="x.png"><figcaption>A picture</figcaption></figure><pre>x =   1</pre><ul><li>one item<li>two items</ul>
<div class="share-links"><a href="#">Tweet</a> <a href="#">Post</a></div><p class="ad">Buy this</p><p>Last words.</p>
<section class="comments"><p>The reader says that it is not so, and that the story was better when they had it in the other paper that he has at home with him.</p></section></article>
<aside><p>Read the other story of the week</p></aside><form><label>Name <input></label><button>Send</button></form>
<footer>&copy; 2020 the site &middot; all of it</footer>"""
TEXT = [
    "A headline <here>", "Short one.",
    "The first paragraph of the story is about the man who was with his dog in the house, and it is long enough to be sure of, as it has more than two hundred characters and many of the words that are on the list for English. Next line.",
    "A picture", "x = 1", "one item", "two items", "Last words.",
]
LONG = "The story of the town is that it was on the river and that the people who were in it had to go to the other side for all of their food. " * 2


def test_a_page_with_everything(spark):
    assert main_text(PAGE, BlockRules())[0].split("\n") == TEXT


def test_pages_without_an_article_go_by_the_rules():
    page = f"<div>Menu</div><div><a href=x>One of the links that is here</a> | <a href=y>and another of the links</a></div><h1>Head</h1><div id=main><p>{LONG}<p>short<p>{LONG}</div><div>Imprint</div><div>Data</div><div>Jobs</div><p>{'zzz qqq ' * 40}</p>"
    text = main_text(page, BlockRules())[0].split("\n")
    assert text == ["Head", LONG.strip(), "short", LONG.strip(), "Imprint", "Data"]  # by the nearest neighbour; the last block is long and has no stop word
    assert main_text(f"<p>{LONG}", BlockRules())[0] == LONG.strip()
    assert main_text("<article><h1>x</h1><p>y</article>", BlockRules())[0] == "x\ny"
    assert main_text("<main><p>a<article class=comment><p>b</article><div hidden>c</div></main>", BlockRules())[0] == "a"


def test_broken_pages(spark):
    odd = [None, "", "   ", "plain text", "<", "<p", "<p>a<!-- never ends", "<script>never ends", '<p title="never ends>x', "&amp", "<p>&#65;&#x42;&bogus;</p>", "</p></div></article>", "<article><p>1 < 2 > 0</article>", "<article>" * 300 + "deep", "\x00<p>\x00"]
    rows = [(k, f"u{k}", h, "x", "x", 1) for k, h in enumerate(odd)] + [(3, "u3", "plain text", "x", "x", 1), (None, None, f"<p>{LONG}", "x", "x", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_blocks string, n_chars long")
    got = {r["page_id"]: r for r in extract_text(frame).collect()}
    assert extract_text(frame).count() == len(rows) and extract_text(frame.limit(0)).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[0]["text"] == "" and got[12]["text"] == "1 < 2 > 0" and got[None]["text"] == LONG.strip()
    assert [b.text for b in blocks("<p>a<br>b &amp; c</p>\n<p>d")] == ["a b & c", "d"]
    page = "<article>" + "<p>x</p>" * 20_000 + "</article>"
    assert main_text(page, BlockRules())[1:] == (20_000, 20_000)


def test_registered_pages(spark):
    """On the given tables the article is what stands between its tags."""
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op12_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
        assert r["text"] == "\n".join(x for x in parts if x) and r["url"] == pages[r["page_id"]]["url"]


# runs


def all_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, size, q) for (i, size), q in found.items())


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words = [str(rng.randrange(rng.choice([1, 2, 3, 5, 50]))) for _ in range(rng.randrange(0, 120))]
            if rng.random() < 0.6 and words:
                a, p = rng.randrange(len(words)), rng.randrange(1, 8)
                words = words[:a] + (words[a : a + p] * 20)[: rng.randrange(60)] + words[a:]
                words = words + words if rng.random() < 0.3 else words
            texts.append(" ".join(words))
        row, start, length, period = runs_of_slice(Words(pa.array(texts), SPACED, False), 12)
        for k, text in enumerate(texts):
            mine = sorted(map(tuple, np.stack([start, length, period], axis=1)[row == k].tolist()))
            assert mine == all_runs(text.split())


def test_known_words():
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for word in (fibonacci[-1], "ab" * 300, "a" * 500, "".join("ab"[bin(k).count("1") % 2] for k in range(512)), "abc" * 9 + "x" + "abc" * 9):
        for least in (2, 12, 30):
            row, start, length, period = runs_of_slice(Words(pa.array([" ".join(word)]), SPACED, False), least)
            assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == sorted(all_runs(list(word), least), key=lambda r: (r[0], r[2]))


def test_a_grammar_spells_its_text():
    ids = np.array([0, 1, 0, 1, 2, 0, 1, 0, 1, 2, 2, 2, 2, 0])
    doc = np.array([0] * 9 + [1] * 5)
    grammar = runs.Grammar(ids, doc)
    words = {}
    for node, place, size, left in zip(grammar.node, grammar.place, grammar.size, grammar.left, strict=True):
        assert 0 < left < size and len(set(doc[place : place + size])) == 1
        assert words.setdefault(int(node), tuple(ids[place : place + size])) == tuple(ids[place : place + size])  # one expansion wherever it stands
    assert len(words) < len(grammar.node)


def test_runs_of_odd_tables(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t\x0b", "en"), (4, "a " * 12, "en"), (4, "a " * 11, "en"), (None, "x " + "a b " * 9 + "y", "en"), (6, "a b " * 30, "en"), (7, "w " * 60_000 + "end", "en")]
    got = find_runs(table(spark, rows)).collect()
    assert len(got) == len(rows) and find_runs(table(spark, rows).limit(0)).count() == 0
    told = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got)
    assert told == Counter([
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 12, ((0, 12, 1),), "a"), (4, 11, (), " ".join("a" * 11)), (None, 20, ((1, 18, 2),), "x a b y"), (6, 30, ((0, 30, 1),), "a b"), (7, 60_001, ((0, 60_000, 1),), "w end"),
    ])


def test_registered_runs(spark):
    """The whole table, but for texts too long for brute force, whose runs are checked for what they claim."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = all_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        drop = {k for start, size, q in found for k in range(start + q, start + size)}
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(found, key=lambda r: (r[0], r[2])))
        want = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in drop).encode()).hexdigest())
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == want


@pytest.mark.parametrize("rows", [[], [(0, None)], [(5, "a b c d e f g h i j k l m")]])
def test_repeated_tails_of_small_tables(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert queries.with_tail_repeated(frame).count() == len(rows)


# registered queries of earlier operators, on the whole given tables


def test_registered_chat(spark):
    """Digests of every conversation, -7 too, and windows that keep to their budget as their text stands."""
    from bindwell.llm import chat
    from bindwell.llm.encode import Encoder

    said = "</s>[INST] ok [/INST]"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in queries.QUERIES["op4_chat_format"](spark, SF).collect()}
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (1024, 200):
        windows = chat.format_conversations(frame, path, budget=budget).collect()
        encoder = Encoder(path)
        for w in windows:
            assert w["n_tokens"] == len(encoder.encode([w["text"].encode()])[0])
            alone = sum(1 for k in w["turns"] if k >= max(w["turns"]))
            assert w["n_tokens"] <= budget or (alone == 1 and len(w["turns"]) <= 2)
    assert chat.format_conversations(frame.limit(0), path).count() == 0
    long = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"word {k} " * 5) for k in range(3000)], "conv_id long, turn long, role string, text string")
    told = chat.read_back(chat.format_conversations(long, path)).first()
    assert told["n_turns"] == 3000 and told["loss_chars"] == sum(len(f"word {k} " * 5) for k in range(0, 3000, 2))


def test_registered_licences(spark):
    """The base columns against a plain search, and a long text with many spans in time that grows with it."""
    from bindwell.llm.license_scan import BASE, scan_licenses

    low = {k: k + 32 for k in range(65, 91)}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_license_scan"](spark, SF).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    rows = [(1, "x cc by nc " * 20_000), (1, "x cc by nc " * 2), (None, None), (2, "")]
    many = {r["n_words"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = [s for s in many[80_000]["spans"] if s["base"]]
    assert len(spans) == 20_000 and [s["first_word"] for s in spans[:3]] == [1, 5, 9] and spans[-1]["last_word"] == 79_999 - 0
    assert scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_registered_languages(spark):
    """Every text of the given table: the fold, ``und`` where there is no letter, and accuracy on texts that were held out."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op1_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text = docs[r["doc_id"]]["text"] or ""
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text))
        if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und":
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)


def test_language_sample_is_bounded_and_repeats_are_judged_singly(spark):
    from bindwell.llm import langid

    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * (1 + k % 5), "en" if k % 2 else "de") for k in range(200)]
    rows += [(3, "the cat and the dog", "en"), (3, None, "en"), (None, "der hund", "de"), (7, "", "en"), (8, "katze " * 200_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = langid.train(docs, F.lit(True), max_train=50, max_bytes=2000)
    assert small.languages and langid.train(docs, F.lit(True), max_train=50).languages == ["de", "en"]
    model = langid.train(docs, F.lit(True))
    got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model).collect())
    assert got[3, "en"] == 2 and got[3, "und"] == 1 and got[None, "de"] == 1 and got[7, "und"] == 1 and got[8, "de"] == 2
