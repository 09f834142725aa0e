"""N-gram Jaccard join with parity sketches.

Two sets of sizes a and b with Jaccard similarity of at least 0.8 differ in at most (a + b) / 9
tokens. Tokens are dealt by hash into the K blocks of their size band and each block is the XOR of
its tokens' hashes, a parity sketch: a token in one set only changes one block. With d differences,
K - d blocks agree (pigeonhole). Ordering blocks by a rule on their content alone (most tokens
first), each set may leave out its K - d - 1 last blocks and one agreeing block is still kept by
both, so a set of n tokens has about n / 4 join keys, none of them an almost empty block.

Sets that share a key are candidates. To stay linear in a group's size, candidates are taken in
steps: each member is compared with its key's smallest member, then with the one that shares most
keys with others, and links found so contract a group to few components; only pairs of different
components that share a key are then compared, in blocks of bounded size. Before sets are compared, a second parity sketch (each token flips one bit,
so the Hamming distance is at most the symmetric difference) rules most out. It has twice as many
bits as the set has tokens, rounded up to a power of two, so that it tells large sets apart as well as small
ones; sketches of two widths are compared at the narrower one's, to which the wider one is folded.
Comparison is exact on 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindwell.llm.graph import components
from bindwell.llm.store import bounded, cut, fresh_path, written
from bindwell.llm.text import SPACED, U64, Words, map_texts, mix, trimmed

#: Bits of the narrowest sketch.
SKETCH_BITS = 512
#: Members of a key's group that are compared with each other in one piece of work.
CELL = 512


class Rule:
    """A threshold of num / den: the most differences of a pair and the sizes that can be partners."""

    def __init__(self, num: int, den: int, spare: float = 1.5):
        self.num, self.den, self.spare = num, den, spare

    def differences(self, total):
        """Most differing tokens of a pair with ``total`` tokens together: I >= t (a + b) / (1 + t)."""
        return total * (self.den - self.num) // (self.den + self.num)

    def changed(self, total):
        """Differences up to which a pair is sure to share a key."""
        return self.differences(total)

    def prints(self, tokens, begins):
        """What a block is known by: here the parity of its tokens, which stand together from ``begins`` on."""
        return np.bitwise_xor.reduceat(mix(tokens ^ U64(0x9FB21C651E98DF25)), begins)

    def near(self, apart, total):
        """Whether sketches ``apart`` bits apart allow a link of the pair with ``total`` tokens together."""
        return apart <= self.differences(total)

    def largest(self, n):
        return n * self.den // self.num

    def blocks(self, d):
        return np.ceil((d + 1) * self.spare).astype(np.int64)


class Sketches:
    """Parity sketches of several widths, all of them powers of two."""

    def __init__(self, cells):
        self.width = np.fromiter(map(len, cells), np.int64, len(cells)) // 8
        self.row = np.empty(len(cells), np.int64)  # in the matrix of its width
        self.of_width = {}
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.row[mine] = np.arange(len(mine))
            self.of_width[w] = np.frombuffer(b"".join([cells[k] for k in mine]), np.uint64).reshape(-1, w)

    def folded(self, which, width: int, to: int) -> np.ndarray:
        """Sketches of one ``width`` as if they had been made with ``to`` words."""
        rows = self.of_width[width][self.row[which]]
        return rows if width == to else np.bitwise_xor.reduce(rows.reshape(len(rows), -1, to), axis=1)

    def apart(self, mine, other: Sketches, theirs) -> np.ndarray:
        """Hamming distances of the sketches ``mine`` from ``theirs`` in ``other``."""
        out = np.empty(len(mine), np.int64)
        widths = self.width[mine] << 32 | other.width[theirs]
        for code in np.unique(widths).tolist():
            same, to = np.flatnonzero(widths == code), min(code >> 32, code & 0xFFFFFFFF)
            x, y = self.folded(mine[same], code >> 32, to), other.folded(theirs[same], code & 0xFFFFFFFF, to)
            out[same] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def parity_sketches(tokens: np.ndarray, rows: np.ndarray, n: np.ndarray, least: int = SKETCH_BITS) -> list[bytes]:
    """The parity sketch of every row's ``n`` tokens."""
    bits = np.maximum(least, 2 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    bit = begin[rows] + (mix(tokens ^ U64(0xD1B54A32D192ED03)) & (bits[rows] - 1).astype(U64)).astype(np.int64)
    parity = np.bincount(bit, minlength=int(bits.sum())).astype(np.uint8) & 1
    packed, ends = np.packbits(parity).tobytes(), ((begin + bits) // 8).tolist()
    return [packed[a:b] for a, b in zip((begin // 8).tolist(), ends, strict=True)]


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, in order of row and hash."""
    at, hashes = words.grams(size)
    rows = words.row[at]
    for n in range(1, size):  # fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(words.count == n)
        if len(short):
            hashes = np.concatenate((hashes, words.gram_at(words.first[short], n)))
            rows = np.concatenate((rows, short))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def block_keys(tokens, rows, rule: Rule, d, k_of, band) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the d + 1 first blocks of the rows with ``k_of`` > 0 blocks."""
    take = k_of[rows] > 0
    tokens, rows = tokens[take], rows[take]
    base = np.concatenate(([0], np.cumsum(k_of)))
    place = ((mix(tokens ^ U64(0x2545F4914F6CDD1D)) >> U64(33)) * k_of[rows].astype(U64) >> U64(31)).astype(np.int64)
    block = base[rows] + place
    order = np.argsort(block, kind="stable")
    block, tokens = block[order], tokens[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.empty(0, np.int64)
    size = np.zeros(base[-1], np.int64)
    print_ = np.zeros(base[-1], U64)
    if len(first):
        size[block[first]] = np.diff(np.append(first, len(block)))
        print_[block[first]] = rule.prints(tokens, first)
    owner = np.repeat(np.arange(len(k_of)), k_of)
    index = np.arange(base[-1]) - base[owner]
    content = mix(print_ ^ mix(index.astype(U64) + U64(1) + (band[owner].astype(U64) << U64(40))))
    order = np.lexsort((content, -size, owner))
    rank = np.empty(base[-1], np.int64)
    rank[order] = np.arange(base[-1]) - base[owner]
    keep = rank <= d[owner]
    return content[keep], owner[keep]


def all_keys(tokens, rows, n_rows: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of every row: those of its size band, and those of a border it may have partners across."""
    n = np.bincount(rows, minlength=n_rows)
    some = n > 0
    level = np.zeros(n_rows, np.int64)
    level[some] = np.floor(np.log2(n[some])).astype(np.int64)
    top = (2 << level) - 1  # largest size of the band
    keys, owners = [], []

    def add(which, d, most, band):
        k = np.where(which, rule.blocks(rule.changed(most)), 0)
        key, owner = block_keys(tokens, rows, rule, d, k, band)
        keys.append(key)
        owners.append(owner)

    add(some, rule.changed(n + np.minimum(rule.largest(n), top)), 2 * top, 3 * level)
    up = some & (rule.largest(n) > top)  # partners in the band above
    add(up, rule.changed(n + rule.largest(n)), top + rule.largest(top), 3 * level + 1)
    low = (1 << level) - 1  # largest size of the band below
    down = some & (rule.largest(low) >= n)
    add(down, rule.changed(n + low), low + rule.largest(low), 3 * level - 2)
    return np.concatenate(keys), np.concatenate(owners)


def _features(docs: DataFrame, id_col: str, text_col: str, size: int, rule: Rule) -> DataFrame:
    """id, number of shingles, parity sketch and join keys of every document."""
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
    ])

    def run(batch):
        words = Words(batch.column(1), SPACED, lower=True)
        tokens, rows = shingle_sets(words, size)
        n = np.bincount(rows, minlength=words.rows)
        keys, owner = all_keys(tokens, rows, words.rows, rule)
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=words.rows))))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(parity_sketches(tokens, rows, n), pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order].view(np.int64))),
            ],
            names=schema.names,
        )

    return map_texts(docs, [id_col, text_col], run, schema)


def _groups(features: DataFrame) -> DataFrame:
    """(key, id, hub) of the keys that two or more documents have, each once; the hub is the smallest of them."""

    def rows_of(key, ident, hub):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ident), pa.array(hub)], names=["key", "id", "hub"])

    def run(batches):
        key, ident = np.empty(0, np.int64), np.empty(0, np.int64)  # the row that waits for the next one
        hub, begins = np.empty(0, np.int64), True  # its hub, and whether it is its key's first row
        for batch in batches:
            key = np.append(key, batch.column(0).to_numpy())
            ident = np.append(ident, batch.column(1).to_numpy())
            if not len(key):
                continue
            again = np.append(False, (key[1:] == key[:-1]) & (ident[1:] == ident[:-1]))  # a document that stands twice
            key, ident = key[~again], ident[~again]
            new = np.append(begins, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hub = np.where(first < 0, hub[:1] if len(hub) else 0, ident[first])
            shared = np.flatnonzero(~(new[:-1] & new[1:]))
            yield rows_of(key[shared], ident[shared], hub[shared])
            key, ident, hub, begins = key[-1:], ident[-1:], hub[-1:], bool(new[-1])
        if not begins:
            yield rows_of(key, ident, hub)

    rows = features.where("id is not null").select(F.explode("keys").alias("key"), "id")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(trimmed(run), "key long, id long, hub long")


def _sketch_filter(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, na, sa, b, nb, sb) whose sizes and sketches allow a link."""

    @F.pandas_udf("boolean")
    def near(na: pd.Series, sa: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.Series:
        every = np.arange(len(sa))
        apart = Sketches(sa.tolist()).apart(every, Sketches(sb.tolist()), every)
        return pd.Series(rule.near(apart, (na + nb).to_numpy()))

    sizes = F.least("na", "nb") * rule.den >= F.greatest("na", "nb") * rule.num
    return pairs.where(sizes).where(near("na", "sa", "nb", "sb")).select("a", "b")


def _verified(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, size: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. Only their documents' sets are moved."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    wanted = cut(pairs.select(F.col("a").alias("__wanted")).union(pairs.select("b")).distinct())
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    mine = mine.join(bounded(wanted), F.col("id") == F.col("__wanted"), "left_semi")

    def run(batch):
        words = Words(batch.column(1), SPACED, lower=True)
        tokens, rows = shingle_sets(words, size)
        cuts = np.searchsorted(rows, np.arange(words.rows + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["id", "tokens"]
        )

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
            out.append(common > 0 and common * rule.den >= rule.num * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    sets = cut(map_texts(mine, ["id", "text"], run, "id long, tokens binary"))
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return cut(with_b.where(similar("ta", "tb")).select("a", "b").distinct())


def _hubs(members: DataFrame) -> DataFrame:
    """(key, hub, hub_component, size): of each key the member that shares most keys with others, and how many members there are."""
    shared = members.groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    best = F.max_by(F.struct("id", "component"), F.struct("shared", -F.col("id")))
    hubs = members.join(shared, "id").groupBy("key").agg(best.alias("hub"), F.count(F.lit(1)).alias("size"))
    return hubs.select("key", F.col("hub.id").alias("hub"), F.col("hub.component").alias("hub_component"), "size")


def _cells(members: DataFrame, light: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of one key and of different components that sizes and sketches allow.

    ``members``: key, id, component; ``light``: id, n, sketch. A key's members are dealt by the hash of
    their id into pieces of about CELL, and every two pieces meet in a cell, so no group is held whole.
    Keys with the same hub mostly have the same members: their cells are dealt alike and stand together,
    so a pair that shares many keys comes out once. Sketches join last and are shuffled once.
    """
    hubs = written(_hubs(members).drop("hub_component"), "hubs")
    pieces = hubs.groupBy("hub").agg(F.ceil(F.max("size") / CELL).cast("int").alias("pieces"))
    dealt = members.join(hubs.join(pieces, "hub").select("key", "hub", "pieces"), "key")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece")
    x = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("x")
    spread = dealt.select("key", "hub", "id", "component", piece, x)
    spread = spread.select("hub", F.least("piece", "x").alias("i"), F.greatest("piece", "x").alias("j"), "key", "piece", "id", "component").join(light, "id")

    def pairs_of(cells: pd.DataFrame, cell: np.ndarray, group: np.ndarray) -> np.ndarray:
        """(group, a, b). Rows of a cell stand together. Every row meets the row ``apart`` places on, for every such distance in a cell."""
        n, component, ident, piece = (cells[c].to_numpy() for c in ("n", "component", "id", "piece"))
        whole = (cells["i"] == cells["j"]).to_numpy()
        sketches = Sketches(cells["sketch"].tolist())
        ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
        left = ends[np.searchsorted(ends, np.arange(len(cell)), "right")] - np.arange(len(cell)) - 1  # rows of the cell that follow
        found, x, apart = [np.empty((0, 3), np.int64)], np.flatnonzero(left), 1
        while len(x):
            y = x + apart
            low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            fit = (component[x] != component[y]) & (whole[x] | (piece[x] != piece[y])) & (low * rule.den >= high * rule.num)
            u, v = x[fit], y[fit]
            close = rule.near(sketches.apart(u, sketches, v), n[u] + n[v])
            u, v = u[close], v[close]
            found.append(np.stack([group[u], np.minimum(ident[u], ident[v]), np.maximum(ident[u], ident[v])], axis=1))
            apart += 1
            x = x[left[x] >= apart]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[pairs[:, 1] != pairs[:, 2]]

    def run(frames):
        rest, seen, of = None, np.empty((0, 2), np.int64), None  # pairs that the group ``of`` (hub, i, j) has given already

        def fresh(rows: pd.DataFrame, cell: np.ndarray) -> pd.DataFrame:
            nonlocal seen, of
            label = rows[["hub", "i", "j"]].to_numpy()
            group = np.append(0, np.cumsum((label[1:] != label[:-1]).any(axis=1)))
            pairs = pairs_of(rows, cell, group)
            if of is not None and tuple(label[0]) == of and len(seen):
                first = pairs[:, 0] == 0
                again = np.zeros(len(pairs), bool)
                again[first] = np.isin(_pair_codes(pairs[first, 1:]), _pair_codes(seen))
                pairs = pairs[~again]
            last = pairs[pairs[:, 0] == group[-1], 1:]
            seen = np.concatenate((seen, last)) if of == tuple(label[-1]) else last
            of = tuple(label[-1])
            return pd.DataFrame(pairs[:, 1:], columns=["a", "b"])

        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            label = rest[["hub", "i", "j", "key"]].to_numpy()
            cell = np.append(0, np.cumsum((label[1:] != label[:-1]).any(axis=1)))[: len(rest)]
            done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            if done:
                yield fresh(rest.iloc[:done], cell[:done])
                rest = rest.iloc[done:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield fresh(rest, np.zeros(len(rest), np.int64))

    ordered = spread.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "key")
    return ordered.mapInPandas(trimmed(run), "a long, b long").distinct()


def _pair_codes(pairs: np.ndarray) -> np.ndarray:
    """Pairs as values that can be looked up."""
    return np.ascontiguousarray(pairs, np.int64).view([("a", np.int64), ("b", np.int64)]).ravel()


def linked_components(features: DataFrame, rule: Rule, verify) -> DataFrame:
    """(node, component) of the nodes with links, from stored ``features`` (id, n, sketch, keys).

    ``verify`` turns candidate pairs (a, b) into the pairs that are links.
    """
    groups = written(_groups(features), "groups")
    stars = cut(groups.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    light = features.where("id is not null").select("id", "n", "sketch").distinct()
    ends = [light.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"]
    links = verify(_sketch_filter(stars.join(ends[0], "a").join(ends[1], "b"), rule))
    found = cut(components(links))
    members = _mixed(groups.select("key", "id"), found)
    middle = cut(_middle_pairs(members).join(stars, ["a", "b"], "left_anti"))
    more = verify(_sketch_filter(middle.join(ends[0], "a").join(ends[1], "b"), rule))
    if not more.isEmpty():
        links = links.union(more)
        found = cut(components(links))
        members = _mixed(members.select("key", "id"), found)
    tested = stars.union(middle).union(middle.select("b", "a"))
    new = verify(_cells(members, light, rule).join(tested, ["a", "b"], "left_anti"))
    return found if new.isEmpty() else cut(components(links.union(new)))


def _mixed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, component) of the keys whose members are not all in one component; of keys with the same members one."""
    labelled = groups.join(found, F.col("id") == F.col("node"), "left")
    labelled = written(labelled.select("key", "id", F.coalesce("component", "id").alias("component")), "labelled")
    sets = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.bit_xor(F.xxhash64("id")).alias("set"), F.count(F.lit(1)).alias("size"))
    mixed = sets.where("x <> y").groupBy("set", "size").agg(F.min("key").alias("key")).select("key")
    return written(labelled.join(mixed, "key", "left_semi"), "mixed")


def _middle_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key's middle member with those of other components.

    Copies of one text that differ from each other often have links only with the text itself: it is
    the one that shares most keys with others. Only what has no link with it is compared in pairs.
    """
    pairs = members.join(_hubs(members), "key").where(F.col("component") != F.col("hub_component"))
    return pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def links_and_components(docs: DataFrame, id_col: str, text_col: str, size: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Features (id, n) of every row, and (node, component) of the documents with links."""
    path = fresh_path(docs.sparkSession, "jaccard")
    _features(docs, id_col, text_col, size, rule).write.parquet(path)
    features = docs.sparkSession.read.parquet(path)
    found = linked_components(features, rule, lambda pairs: _verified(docs, id_col, text_col, pairs, size, rule))
    return features.select("id", "n"), found


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5
) -> DataFrame:
    """Groups of documents linked by shingle sets with a Jaccard similarity of ``num / den`` or more.

    Words are white-space separated, A-Z lower-cased; shingles are ``size`` words; fewer words are
    one shingle. Ids are integers. Returns for each row: ``id_col``, ``n_shingles`` and
    ``component_id`` (smallest id reachable by links, its own included). Wordless, empty and null
    texts have no shingles and no links. A null id has a null component and no links. Rows that
    repeat an id are one document that has each of their links. An empty table gives an empty
    result. Other columns are not read.
    """
    features, found = links_and_components(docs, id_col, text_col, size, Rule(num, den))
    joined = features.join(found, F.col("id") == F.col("node"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
