"""The operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from bindwell.llm import chat, fmindex, graph, jaccard, langid, license_scan, line_dedup, packing, substring, tokenbin
from bindwell.llm.decontam import decontaminate
from bindwell.llm.dedup_exact import exact_dedup, repeat_filter
from bindwell.llm.encode import Encoder
from bindwell.llm.text import ALNUM, SPACED, Words, mix

SCHEMA = "doc_id long, text string, lang string, h string, n long, key string, words string, id string, sha string, th string, row string, part string"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def table(spark, texts, first=0):
    """Documents with extra columns that clash with names the operators use."""
    rows = [(k if isinstance(k, int) or k is None else None, t, "en", *["x", 1, "x", "x", "x", "x", "x", "x", "x"]) for k, t in (texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts, first)))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 4, 5, 6, 20, 80, 200]), 500) for _ in range(60)]
    for k in range(30):  # near copies
        words = texts[k].split()
        for _ in range(rng.randrange(1 + len(words) // 60)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        texts.append(" ".join(words).upper() if k % 5 == 0 else " ".join(words))
    passage = prose(rng, 60, 500)
    texts += [f"{prose(rng, 30, 500)} {passage} {prose(rng, 9, 500)}" for _ in range(8)]
    return [*texts, "", None, " \n\t ", "één twee drie ß ü", texts[3], texts[3], "x" * 5000, prose(rng, 9000, 4000)]


def test_words_and_grams():
    words = Words(pa.array(["Ab, cDé", None, "", "x  y\nz"]), SPACED, lower=True)
    assert words.count.tolist() == [2, 0, 0, 3]
    assert words.span(0, 2).decode() == "ab, cdé"
    assert len(words.grams(2)[0]) == 3
    assert Words(pa.array(["a-b 12é!"]), ALNUM, lower=True).count.tolist() == [3]


def test_exact_dedup(spark):
    texts = [(3, "a b"), (1, "ab"), (2, "a  b"), (7, None), (5, ""), (6, " "), (8, "c"), (8, "c"), (None, "c"), (9, "\x0bq\x0c")]
    got = exact_dedup(table(spark, texts)).collect()
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for k, t in texts:
        groups[squeeze(t)].append((-len(t or ""), k is None, k or 0))
    want = Counter()
    for k, t in texts:
        best = min(groups[squeeze(t)])
        want[(k, best[2], len(groups[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup(table(spark, []).limit(0)).count() == 0


def test_exact_dedup_with_a_full_filter(spark):
    texts = [f"t{k % 70}" for k in range(100)]
    got = exact_dedup(table(spark, texts), max_bits=1 << 16, bits_per_row=1, n_hashes=1).collect()
    assert Counter(r["group_size"] for r in got) == {1: 40, 2: 60}
    bits = repeat_filter(spark.range(5).union(spark.range(2)), 1 << 16, 3)
    assert np.unpackbits(bits).sum() <= 6


def similar_groups(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_jaccard_join(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(table(spark, corpus)).collect()}
    assert got == similar_groups(corpus)


def test_jaccard_edges_of_the_table(spark):
    assert jaccard.jaccard_join(table(spark, []).limit(0)).count() == 0
    rows = jaccard.jaccard_join(table(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["doc_id"] is not None) == [(False, 2)] * 3
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]


def test_keys_meet_whatever_the_size():
    rng, rule = np.random.default_rng(1), jaccard.Rule(4, 5)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        drop = int(rng.integers(0, n // 5 + 1))
        b = a[drop:] if n - drop else a
        if 5 * len(b) < 4 * len(a):
            continue
        tokens, rows = np.concatenate((np.sort(a), np.sort(b))), np.repeat([0, 1], [len(a), len(b)])
        key, row = jaccard.all_keys(tokens, rows, 2, rule)
        assert set(key[row == 0]) & set(key[row == 1])


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_substring_dedup(spark, corpus):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in corpus]
    for most in (50_000, 3):
        first = {}
        for k, w in enumerate(words):
            for i in range(len(w) - 12):
                first.setdefault(tuple(w[i : i + 13]), k)
        got = {r["doc_id"]: r for r in substring.substring_dedup(table(spark, corpus), most=most).collect()}
        for k, w in enumerate(words):
            gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(13)}
            kept = " ".join(x for i, x in enumerate(w) if i not in gone)
            assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.substring_dedup(table(spark, []).limit(0)).count() == 0


def test_fm_index_gives_matching_statistics():
    """Against all substrings of the text: the longest match that stands twice, its places, and their smallest owner."""
    rng = np.random.default_rng(2)
    codes = np.append(rng.integers(1, 6, 400), 0)
    owners = rng.integers(0, 50, len(codes))
    index, text = fmindex.FMIndex(codes, 8, owners), codes.tolist()
    stream = np.append(rng.integers(1, 6, 60), codes[100:160])
    ends = np.arange(8, len(stream))
    reach, low, high = index.matching_statistics(stream, ends, 8)
    for k, e in enumerate(ends):
        places = lambda n: [i for i in range(len(text) - n + 1) if text[i : i + n] == stream[e - n + 1 : e + 1].tolist()]  # noqa: B023, E731
        n = max((n for n in range(1, 9) if len(places(n)) > 1), default=0)
        assert reach[k] == n
        assert high[k] - low[k] == (len(places(n)) if n else len(text))
    some = np.flatnonzero(reach == 3)
    least = index.least_owner(low[some], high[some])
    for k, got in zip(some, least, strict=True):
        e = ends[k]
        assert got == min(owners[i] for i in range(len(text) - 2) if text[i : i + 3] == stream[e - 2 : e + 1].tolist())


def test_decontamination(spark):
    rng = random.Random(1)
    items = [prose(rng, n, 300) for n in (20, 13, 5, 1, 0)] + [None]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(0, items[0]), (None, "w1")], "item_id long, text string")
    docs = [prose(rng, 50, 300), f"x {items[0]} y", f"q {items[1].upper()} " + prose(rng, 400, 300), items[2], items[3], "", None, "w1", " ".join(items[0].split()[3:18])]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for block in (1_000_000, 4):
        got = {r["doc_id"]: r for r in decontaminate(table(spark, docs), bench, block_windows=block).collect()}
        for k, d in enumerate(docs):
            w, hit, found = find(d), set(), set()
            for item, t in enumerate(items):
                x = find(t)
                m = min(13, len(x))
                wins = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if x else set()
                for i in range(len(w) - m + 1) if wins else ():
                    if tuple(w[i : i + m]) in wins:
                        hit |= set(range(i, i + m))
                        found.add(str(item))
            r = got[k]
            want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    assert decontaminate(table(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_gives_the_same_rows_for_any_benchmark_size(spark):
    """Null and repeated ids and carried columns, in one pass and in several."""
    rng = random.Random(4)
    items = [prose(rng, 20, 300) for _ in range(3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(1, items[0]), (1, prose(rng, 40, 300)), (1, f"a {items[1]} b {items[2]}"), (None, items[2]), (None, items[2]), (None, "x y"), (2, None)]
    once, often = (decontaminate(table(spark, docs), bench, block_windows=n, carry=("text", "lang", "n")) for n in (1_000_000, 5))
    assert once.columns == often.columns
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, often.collect()))
    assert often.count() == len(docs) and sum(r["contaminated"] for r in often.collect()) == 4


def test_pipeline_stage_with_a_large_benchmark(spark, monkeypatch):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(str, corpus_pipeline.uncontaminated(spark, docs, sf).collect()))
    many = lambda *args, **kwargs: decontaminate(*args, **kwargs, block_windows=300)
    monkeypatch.setattr(corpus_pipeline, "decontaminate", many)
    assert sorted(map(str, corpus_pipeline.uncontaminated(spark, docs, sf).collect())) == want


def test_license_scan(spark):
    docs = ["Under the MIT License! x", "released under the MIT licence", "CC-BY NC and Apache License, version 2.0", "cc by nc cc by nc", None, "", "clean words only", "GNU Genral Public License"]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(table(spark, docs)).collect()}
    labels = {k: sorted({s["label"] for s in r["spans"]}) for k, r in got.items()}
    assert labels == {0: ["mit"], 1: ["mit"], 2: ["apache-2", "cc-by-nc"], 3: ["cc-by-nc"], 4: [], 5: [], 6: [], 7: ["gpl"]}
    base = {k: [(s["first_word"], s["label"]) for s in r["spans"] if s["base"]] for k, r in got.items()}
    assert base[0] == [(0, "mit")] and base[1] == [] and base[2] == [(0, "cc-by-nc"), (4, "apache-2")] and base[3] == [(0, "cc-by-nc"), (3, "cc-by-nc")]
    assert got[1]["spans"][0]["edits"] == 1 or got[1]["spans"][0]["score"] < 1
    assert [got[k]["n_words"] for k in range(6)] == [5, 5, 9, 6, 0, 0]


def test_pieces_survive_edits():
    rng = random.Random(0)
    for phrase, label in license_scan.BASE + license_scan.NOTICES:
        k = license_scan.edits_for(phrase, 12)
        assert "".join(p for _, p in license_scan.pieces(phrase, k)) == phrase
        for _ in range(20):
            text = list(phrase)
            for _ in range(k):
                text[rng.randrange(1, len(text) - 1)] = "z"
            found = license_scan.find_notices(f" a {''.join(text)} b ", license_scan.BASE + license_scan.NOTICES, 12)
            assert label in {f[0] for f in found}


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_ids_are_the_library_s(path, corpus):
    odd = ["", " ", "  a  b", "a \n b\n\nc  d ", "a  b", " <|endoftext|> x", "'s it's  don't\tq", "\n", "a  b", "É É İ", "12 34\r\n", "x\x1c y", "Straße.\nNeu, ja", "a.b,c d.e"]
    texts = [t or "" for t in corpus] + odd
    encoder = Encoder(path)
    for _ in range(2):
        got = encoder.encode([t.encode() for t in texts])
        assert [g.tolist() for g in got] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, corpus):
    encoder = Encoder(BYTES)
    rows = packing.pack(table(spark, corpus), BYTES, max_tokens=128).collect()
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(corpus):
        ids = np.append(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2).astype("<u4")
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 128)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 128 for r in own[1:])
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-tokens // 128) + 3
    assert packing.pack(table(spark, []).limit(0), BYTES).count() == 0


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(0)
    histogram = np.zeros(257, np.int64)
    for n in rng.integers(1, 257, 5000):
        histogram[n] += 1
    used = np.zeros_like(histogram)
    for shape, times in packing.plan_sequences(histogram):
        assert sum(shape) <= 256
        for n in shape:
            used[n] += times
    assert (used == histogram).all()
    count = sum(times for _, times in packing.plan_sequences(histogram))
    assert count <= 1.01 * (histogram * np.arange(257)).sum() / 256 + 1


@pytest.mark.parametrize("width", [1, 8])
def test_planes_round_trip(width):
    rng = np.random.default_rng(4)
    for lengths in ([], [1], [5, 0, 9000, 3], [70000]):
        ids = rng.integers(0, 49408, sum(lengths)).astype(np.uint32)
        segment = tokenbin.Segment(tokenbin.write_segment(ids, np.array(lengths, np.int64), width, block=4096))
        assert segment.read().tolist() == ids.tolist() and segment.lengths.tolist() == lengths
        if sum(lengths) > 4096:
            assert segment.read_block(1).tolist() == ids[4096:8192].tolist()


def test_token_files(spark, corpus):
    encoder, start = Encoder(WORDS), 0
    docs = table(spark, [(len(corpus) - k, t) for k, t in enumerate(corpus)])
    got = {r["doc_id"]: r for r in tokenbin.token_file_digest(docs, WORDS, segment_ids=500).collect()}
    for k in range(1, len(corpus) + 1):
        ids = np.append(encoder.tokenizer.encode(corpus[len(corpus) - k] or "", add_special_tokens=False).ids, 2).astype("<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenbin.token_file_digest(table(spark, []).limit(0), WORDS).count() == 0


def test_chat_windows(spark):
    rng = random.Random(2)
    said = ["</s>[INST] ok [/INST]", "\\<s>\\\\", "", None, "plain words " * 30, "<<s>/s>[[INST]"]
    turns = []
    for conv in (*range(12), None):
        n = rng.randrange(1, 14)
        turns += [(conv, t, "system" if t == 0 and (conv or 0) % 2 else rng.choice(["user", "assistant", None]), rng.choice(said)) for t in range(n)]
    turns.append((3, 1, "user", "tied turn"))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", __import__("pyspark.sql.functions").sql.functions.lit("clash"))
    windows = chat.format_conversations(df, BYTES, budget=80, history=30)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for row in turns:
        by[row[0]].append(row)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
        loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        assert w["n_tokens"] <= 80 or len(w["turns"]) <= 2
    for text in said:
        assert chat.unescape(chat.escape(text or "")) == (text or "") and "</s>" not in chat.escape(text or "")


def test_language_id(spark):
    rng = random.Random(0)
    letters = {"aa": "abcde ", "bb": "fghij ", "cc": "éßüöä "}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(60)), lang) for k in range(300) for lang in [rng.choice(list(letters))]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "bb"), (902, "123 !?", None), (903, "abc", None)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = langid.train(docs, F.col("doc_id") % 4 != 2, max_train=150)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows if k % 4 == 2) >= 0.98 * sum(k % 4 == 2 for k, _, _ in rows)
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.9
    empty = langid.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def letters(rng, n):
    """Words without digits, which lines don't tell apart."""
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))


def test_simhashes_vote_once_a_token():
    rng = np.random.default_rng(8)
    groups = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 2, 3, 40, 900)]
    begins = np.cumsum([0, *map(len, groups)])[:-1]
    for group, got in zip(groups, line_dedup.simhashes(np.concatenate(groups), begins).tolist(), strict=True):
        votes = [int(x) for x in mix(group ^ np.uint64(0x6A09E667F3BCC909))]
        tie = int(np.bitwise_xor.reduce(mix(group ^ np.uint64(0x9FB21C651E98DF25))))
        sums = [2 * sum(v >> k & 1 for v in votes) for k in range(64)]
        assert got == sum(1 << k for k in range(64) if sums[k] > len(votes) or (sums[k] == len(votes) and tie >> k & 1))


def test_edit_distances():
    rng, pairs = random.Random(11), []
    for _ in range(400):
        a = letters(rng, rng.randrange(1, 12))
        b = a
        for _ in range(rng.randrange(4)):
            b = edited(rng, b) if " " in b else b + "x"
        true = distance(a, b)
        assert true <= line_dedup.edits_by_words(a.split(" "), b.split(" "))
        for most in range(max(0, true - 2), true + 3):
            assert line_dedup.edits_within(a, b, most) == (true <= most)
        pairs.append((a, b, true <= max(len(a), len(b)) // 10))
    long = letters(rng, 900)
    pairs += [(long, edited(rng, long), True), (long, letters(rng, 900), False), ("é" * 40, "é" * 39 + "ü", True), ("a", "a", True), ("a", "b", False)]
    assert line_dedup.alike([x[0] for x in pairs], [x[1] for x in pairs]).tolist() == [x[2] for x in pairs]
    assert line_dedup.alike([], []).tolist() == []


def test_line_dedup_finds_edited_long_lines(spark):
    """Lines of 300 words with one changed word are mostly found; lines that share half their words never."""
    rng = random.Random(9)
    lines = [letters(rng, 300) for _ in range(40)]
    texts = list(lines)
    for line in lines:
        words = line.split()
        words[rng.randrange(300)] = "changed"
        texts.append(" ".join(words))
        texts.append(" ".join(words[:150] + letters(rng, 150).split()))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    edited, other = range(40, 120, 2), [*range(40), *range(41, 120, 2)]
    assert sum(got[k] for k in edited) >= 39 and not any(got[k] for k in other)


def edited(rng, line):
    """The line with one edit: of a letter, a whole word or a space."""
    words, kind = line.split(), rng.choice(["letter", "word", "drop", "add", "merge", "split"])
    k = rng.randrange(len(words) - 1)
    if kind == "letter":
        words[k] = "z" + words[k][1:]
    elif kind in ("word", "add"):
        words[k : k + (kind == "word")] = [letters(rng, 1)]
    else:
        words[k : k + 1 + (kind == "merge")] = {"drop": [], "merge": [words[k] + words[k + 1]], "split": [words[k][:1], words[k][1:]]}[kind]
    return " ".join(words)


def test_line_dedup(spark):
    """Against edit similarity alone over all pairs of distinct lines."""
    rng = random.Random(7)
    long = [letters(rng, rng.choice([6, 9, 14, 25, 60])) for _ in range(14)]
    texts = []
    for k in range(24):
        lines = [long[rng.randrange(14)] for _ in range(3)]
        if k % 3 == 0:
            lines[0] = edited(rng, lines[0])
        if k % 4 == 0:
            lines[1] = lines[1].upper() + "!!"
        texts.append("\n".join([*lines, "", "---"]))
    texts = [*enumerate(["\n".join(long), *texts, "", None, "\n\n", texts[0]]), (4, texts[3]), (None, texts[5])]
    nodes, at = {}, []
    for k, t in sorted({x for x in texts if x[0] is not None}):
        for n, line in enumerate((t or "").encode().split(b"\n")):
            x = line_dedup.normalise(line)
            at.append((k, n, x))
            if x:
                nodes[x] = x

    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    names = list(nodes)
    for i, a in enumerate(names):
        for b in names[:i]:
            if 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and distance(a, b) <= max(len(a), len(b)) // 10:
                nodes[find(a)] = find(b)
    seen, want, of = set(), defaultdict(list), dict(x for x in texts if x[0] is not None)
    for k, n, x in at:
        root = find(x) if x else None
        if root is None or root not in seen:
            want[k].append((of[k] or "").split("\n")[n])
        seen.add(root)
    rows = line_dedup.line_dedup(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        k, t = r["doc_id"], of[r["doc_id"]] if r["doc_id"] is not None else texts[-1][1]
        left = want[k] if k is not None else t.split("\n")
        assert r["text"] == "\n".join(left)
        assert r["n_lines"] == len((t or "").split("\n")) and r["n_removed"] == r["n_lines"] - len(left)
    assert line_dedup.line_dedup(table(spark, []).limit(0)).count() == 0


def test_line_dedup_finds_one_edit_in_lines_of_ordinary_length(spark):
    """The reference is the edit similarity alone, whatever the candidates."""
    rng = random.Random(10)
    pairs = []
    for n in (5, 7, 10, 12, 15, 20, 30, 50, 100):
        for _ in range(20):
            line = letters(rng, n)
            other = edited(rng, line)
            if line != other and distance(line, other) <= max(len(line), len(other)) // 10:
                pairs.append((line, other))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(table(spark, [x for pair in pairs for x in pair])).collect()}
    assert len(pairs) > 140 and not any(got[k] for k in range(0, 2 * len(pairs), 2))
    assert sum(got[k] for k in range(1, 2 * len(pairs), 2)) >= 0.97 * len(pairs)
