"""op8: large groups of lines that share words, and the edit distance of many pairs at once."""

import random

import numpy as np

from bindwell.llm import line_dedup
from tests.llm.test_operators import distance, letters, table


def test_pairs_of_a_large_group_are_not_handed_on(spark):
    """200 lines of the same ten words and two of their own each: alike as sets, no links but those of ten copies with one letter changed."""
    rng = random.Random(21)
    base = letters(rng, 10)
    lines = [f"{base} {''.join(rng.choices('klmnopq', k=12))} {''.join(rng.choices('rstuvwx', k=12))}" for _ in range(200)]
    lines += [x[:-1] + "z" for x in lines[:10]]
    stored = line_dedup.written(line_dedup._lines(table(spark, lines).selectExpr("doc_id as id", "xxhash64(text) as th", "text")), "lines")
    shared = line_dedup.written(line_dedup._shared(stored), "shared")
    members = shared.where("key is not null")
    assert shared.where("key is null").distinct().count() < 210 * line_dedup.FEW / 2  # all pairs: 21,945
    links = line_dedup._cells(stored, line_dedup._mixed(members, spark.createDataFrame([], "node long, component long")))
    assert members.select("id").distinct().count() == 210 and links.distinct().count() == 10 and links.count() < 210
    found = line_dedup._linked(stored)
    assert found.count() == 20 and found.select("component").distinct().count() == 10


def test_key_groups_across_batches(spark):
    """The pairs of small groups and the members of large ones do not depend on how rows are cut into batches."""
    rng = random.Random(22)
    bases = [letters(rng, 9) for _ in range(6)]
    lines = [f"{b} {letters(rng, 1)}" for b, n in zip(bases, (2, 5, 32, 33, 40, 90), strict=True) for _ in range(n)]
    stored = line_dedup.written(line_dedup._lines(table(spark, lines).selectExpr("doc_id as id", "xxhash64(text) as th", "text")), "lines")
    want = sorted(map(tuple, line_dedup._shared(stored).distinct().fillna(0).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, together = spark.conf.get(size), line_dedup.TOGETHER
    try:
        spark.conf.set(size, "7")
        line_dedup.TOGETHER = 7
        got = sorted(map(tuple, line_dedup._shared(stored).distinct().fillna(0).collect()))
    finally:
        spark.conf.set(size, before)
        line_dedup.TOGETHER = together
    assert got == want and any(x[0] for x in want) and not all(x[0] for x in want)


def test_narrow_bands_give_the_edit_distance():
    rng, pairs = random.Random(23), []
    while len(pairs) < 300:
        a = "".join(rng.choices("ab\u00e9 \u00fc", k=rng.choice([0, 1, 3, 30, 64, 90])))
        b = list(a)
        for _ in range(rng.randrange(40)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "c"])
        if abs(len(a) - len(b)) <= line_dedup.NARROW:
            pairs.append((a, "".join(b)) if rng.random() < 0.5 else ("".join(b), a))
    true, (a, b) = np.array([distance(*p) for p in pairs]), zip(*pairs, strict=True)
    assert (line_dedup.letters_apart(list(a), list(b)) <= true).all()
    for most in (0, 3, 17, line_dedup.NARROW):
        some = [k for k, (x, y) in enumerate(pairs) if abs(len(x) - len(y)) <= most]
        got = line_dedup.narrow_within([a[k] for k in some], [b[k] for k in some], np.full(len(some), most))
        assert got.tolist() == [bool(true[k] <= most) for k in some]
