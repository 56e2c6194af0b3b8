import random

from pyspark.sql import functions as F

from skillgrid.operators import numbering


def test_places_and_totals(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(300), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(9)
    got = numbering.number_rows(df, ["k", F.col("i")], "n", by=("g",), ranges=13, first=1).collect()
    for g in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])
        assert sorted((x.n, x.k, x.i) for x in got if x.g == g) == [(n + 1, *x[1:]) for n, x in enumerate(mine)]
    whole = numbering.number_rows(df, ["i"], "n").collect()
    assert sorted((x.n, x.i) for x in whole) == [(i, i) for i in range(2000)]
    assert numbering.number_rows(df.limit(0), ["i"], "n").count() == 0


def test_totals_before(spark, monkeypatch):
    monkeypatch.setattr(numbering, "FAN", 4)
    rows = [(g, i, (i * 7) % 5) for g in ("x", None) for i in range(0, 40, 1 if g else 3)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    want = {(g, i): sum(v for h, j, v in rows if h == g and j < i) for g, i, _ in rows}
    assert {(r.g, r.i): r.t for r in numbering.totals_before(df, "i", "v", "t", by=("g",)).collect()} == want
    alone = df.where("g = 'x'")
    assert {r.i: r.t for r in numbering.totals_before(alone, "i", "v", "t").collect()} == {
        i: w for (g, i), w in want.items() if g}
