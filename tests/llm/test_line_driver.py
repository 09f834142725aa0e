"""op8: what the driver holds does not grow with rounds of joins or with the ids that are looked up."""

import random

from pyspark.sql import functions as F

from bindwell.llm import graph, line_dedup
from tests.llm.test_operators import letters, table


def test_estimates_of_size_do_not_grow_with_rounds(spark):
    """The planner's estimate of a table that is made in rounds of joins, in digits: a product of the sides' in every round before."""
    n = 60
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for _ in range(2):
        found = graph.components(edges)
        edges = edges.join(found, F.col("a") == F.col("node")).select("a", "b")
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(n + 1)]
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 300


def test_many_ids_are_looked_up_without_a_broadcast(spark, monkeypatch):
    rng = random.Random(25)
    lines = table(spark, [letters(rng, 9) for _ in range(300)])
    stored = line_dedup.written(line_dedup._lines(lines.selectExpr("doc_id as id", "xxhash64(text) as th", "text")), "lines")
    wanted = line_dedup.settled(stored.where("node % 3 = 0").select("node").distinct())
    few = sorted(map(tuple, line_dedup._texts(stored, wanted).collect()))
    monkeypatch.setattr(line_dedup, "FEW_IDS", 10)
    monkeypatch.setattr(F, "broadcast", None)
    assert sorted(map(tuple, line_dedup._texts(stored, wanted).collect())) == few and len(few) == wanted.count() > 10


def test_keys_that_stand_once_are_not_moved(spark):
    rng = random.Random(26)
    bases = [letters(rng, 12) for _ in range(200)]
    lines = table(spark, [*bases, *(f"{x} {letters(rng, 1)}" for x in bases[:20])])
    stored = line_dedup.written(line_dedup._lines(lines.selectExpr("doc_id as id", "xxhash64(text) as th", "text")), "lines")
    rows = stored.select(F.explode("keys").alias("key"), F.col("node").alias("id"))
    repeated = rows.groupBy("key").agg(F.countDistinct("id").alias("n")).where("n > 1").select("key")
    kept = line_dedup._repeated_keys(stored).select("key", "id")
    assert rows.join(repeated, "key", "left_semi").exceptAll(kept).isEmpty() and kept.exceptAll(rows).isEmpty()
    assert kept.count() < 0.4 * rows.count()


def test_wide_bands_give_the_edit_distance():
    import numpy as np

    from tests.llm.test_operators import distance

    rng = random.Random(27)
    for words, signs in ((1, "abé "), (2, "abé "), (3, [chr(300 + k) for k in range(100)])):
        a, b, most = [], [], 32 * words - 1
        while len(a) < 40:
            x = rng.choices(signs, k=rng.choice([0, 1, 40, 130, 200]))
            y = list(x)
            for _ in range(rng.randrange(40 * words)):
                k = rng.randrange(len(y) + 1)
                y[k : k + rng.randrange(2)] = rng.choice(["", "a", "c"])
            if abs(len(x) - len("".join(y))) <= most:
                a.append("".join(x))
                b.append("".join(y))
        true = [distance(*p) for p in zip(a, b, strict=True)]
        assert line_dedup.narrow_within(a, b, np.full(40, most), words).tolist() == [d <= most for d in true]
        assert [distance(*line_dedup.between(*p)) for p in zip(a, b, strict=True)] == true


def test_cells_of_any_size_give_the_same_components(spark, monkeypatch):
    """Large groups are dealt by length and into pieces; rows of cells may be cut into batches anywhere."""
    rng = random.Random(28)
    lines = []
    for base in (letters(rng, 12), letters(rng, 30)):
        for _ in range(60):
            words = base.split() + ["".join(rng.choices("klmnop", k=rng.choice([2, 9, 17]))) for _ in range(2)]
            lines += [" ".join(words), " ".join(words)[:-1] + "z"]
    stored = line_dedup.written(line_dedup._lines(table(spark, lines).selectExpr("doc_id as id", "xxhash64(text) as th", "text")), "lines")
    members = line_dedup.written(line_dedup._shared(stored).where("key is not null"), "members")
    members = line_dedup._mixed(members, spark.createDataFrame([], "node long, component long"))

    def found():
        return sorted(map(tuple, graph.components(line_dedup._cells(stored, members)).collect()))

    whole = found()
    monkeypatch.setattr(line_dedup, "CELL", 8)
    monkeypatch.setattr(line_dedup, "TOGETHER_PAIRS", 5)
    monkeypatch.setattr(line_dedup, "PAIR_BYTES", 2000)
    assert found() == whole and len(whole) > 100
