"""Hard negatives against all pairs, and the cover tree's own promises."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import hard_negatives as hn
from skillgrid.llm import queries


def plain(rows, positives=5, negatives=5, window=(80, 100), every=10):
    """All pairs of the distinct rows (id, label, vector)."""
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows
                   if i is not None and lab is not None and v is not None and None not in v})
    out = []
    for a in rows:
        if a[0] % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], b[2])), b) for b in rows if b != a), key=lambda s: (-s[0], s[1][0]))
        for p, b in [s for s in scored if s[1][1] == a[1]][:positives]:
            fits = [s for s in scored if s[1][1] != a[1] and window[0] * p <= 100 * s[0] <= window[1] * p][:negatives]
            out += [(a[0], b[0], n + 1, c[0], p, s) for n, (s, c) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame(rows, "id long, label int, vec array<long>")
    return sorted(tuple(r) for r in hn.mine(df, is_anchor=F.col("id") % every == 0, **kw).collect())


def some_rows(kind, n=300, d=6, seed=4):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        v = rng.normal(0, 1, (12, d))[rng.integers(0, 12, n)] + rng.normal(0, .1, (n, d))
    elif kind == "ties":
        v = rng.integers(-1, 2, (n, d)) / 8
    else:
        v = rng.normal(0, 1, (n, d)) * rng.choice([.1, 1, 5], n)[:, None]
    return [(int(i), int(lab), [int(x) for x in row]) for i, lab, row in
            zip(rng.permutation(n) - 5, rng.integers(0, 4, n), np.floor(256 * v))]


@pytest.mark.parametrize("kind", ["clusters", "ties", "any"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(hn, "TREE", 60)
    monkeypatch.setattr(hn, "REGIONS", 3)
    rows = some_rows(kind)
    want = plain(rows)
    assert mined(spark, rows) == want and want


def test_blocks_of_queries_and_other_parameters(spark, monkeypatch):
    monkeypatch.setattr(hn, "QUERIES_PER_BLOCK", 8)
    rows = some_rows("clusters", 200)
    kw = dict(positives=2, negatives=7, window=(50, 90))
    assert mined(spark, rows, **kw) == plain(rows, **kw)


def test_nulls_copies_and_repeated_rows(spark):
    rows = some_rows("ties", 60, 3)
    same = [(1000 + i, i % 2, [90, 10, -20]) for i in range(400)]  # one vector in most rows
    odd = [(None, 1, [1, 2, 3]), (500, None, [1, 2, 3]), (510, 1, None), (520, 1, [1, None, 3]), (530, 1, []), (540, 1, [50]),
           (550, 0, [40, 1, 2, 9]), (30, 3, [100, 100, 100]), (30, 3, [100, 90, 100])]
    rows = rows + same + odd + same[:50] + rows[:10]
    assert mined(spark, rows) == plain(rows)


def test_large_numbers_and_long_vectors(spark):
    rows = [(i, i % 3, [(i * 7919 + j * 31) % 4000 - 2000 for j in range(700)]) for i in range(40)]
    rows += [(100 + i, i % 2, [(1 << 30) + i, i]) for i in range(20)]
    assert mined(spark, rows) == plain(rows)


def test_empty_tables_and_clashing_names(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1, 2])]) == []
    assert mined(spark, [(10, 1, [3, 4])]) == []
    rows = some_rows("any", 50)
    df = spark.createDataFrame(rows, "id long, label int, vec array<long>").select(
        "*", *[F.lit("x").alias(c) for c in ("gid", "key", "anchor", "region", "part", "n", "score")])
    assert sorted(tuple(r) for r in hn.mine(df, is_anchor=F.col("id") % 10 == 0).collect()) == plain(rows)


def test_cover_tree_bounds():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(0, .05, (400, 4)) + rng.normal(0, 1, 4), rng.normal(0, 1, (300, 4))])).astype(int)
    t = hn.CoverTree(x)
    y = np.concatenate([x, np.sqrt(t.most - (x * x).sum(axis=1))[:, None]], axis=1)

    def below(n):
        return np.concatenate([t.loose[n], *[below(c) for c in t.children[n]]]).astype(int)

    assert sorted(below(0)) == list(range(len(x)))
    for n in range(len(t.centre)):
        assert np.linalg.norm(y[below(n)] - y[t.centre[n]], axis=1).max() <= t.radius[n] + 1e-9
        kids = [t.centre[c] for c in t.children[n]]
        apart = [np.linalg.norm(y[a] - y[b]) for i, a in enumerate(kids) for b in kids[:i]]
        assert not apart or min(apart) > t.radius[n] / hn.BASE
        assert all(t.radius[c] <= t.radius[n] / hn.BASE + 1e-9 for c in t.children[n])


def test_search_skips_what_lies_outside():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (8, 16))
    x = np.floor(256 * np.concatenate([c + rng.normal(0, .02, (64, 16)) for c in centres])).astype(np.int64)
    ids, labels = np.arange(len(x)), np.zeros(len(x), np.int64)
    s = hn.Search(x[:4], np.ones(4, np.int64), ids[:4], np.arange(4), np.full(4, hn._NONE + 1), np.full(4, 1 << 62), False, 5)
    s.tree(x, ids, labels, ids)
    want = np.sort(x[:4] @ x.T, axis=1)[:, ::-1][:, :5]
    assert (s.score == want).all() and s.verified < 4 * len(x) / 3


def test_query_on_odd_embeddings(spark, tmp_path):
    folder = str(tmp_path)
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0, .3, 5).tolist()) for i in range(0, 700, 5)]
    rows += [(1400, 1, [float("nan")] * 5), (1500, 1, [float("inf"), 0., 0., 0., 0.]), (1600, None, [.1] * 5), (1700, 2, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    single = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    clean = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, single(v)) for i, lab, v in rows
             if lab is not None and v is not None and np.isfinite(v).all()]
    got = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, folder).collect())
    assert got == plain(clean, every=100) and got
