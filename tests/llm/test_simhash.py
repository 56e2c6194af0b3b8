"""Fingerprints, near links and components against all pairs."""

import random

import pytest
import xxhash

from skillgrid.llm import simhash
from skillgrid.llm.components import components
from tests.conftest import SF


def plain_fp(t, k=4):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_groups(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A b\tc d e", "É é x y z " * 9, "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fp(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limits", [(500, 6_000_000), (2, 3000)])
def test_links_find_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash, "BUCKET_FINGERPRINTS", limits[0])
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", limits[1])
    rng = random.Random(4)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    group = {r["fp"]: r["group"] for r in simhash.near_groups(df).collect()}
    want = plain_groups(fps, 4)
    by_root: dict = {}
    for f, w in zip(fps, want):
        by_root.setdefault(w, set()).add(signed(f))
    assert {f: min(by_root[w]) for f, w in zip(map(signed, fps), want)} == group


def test_documents(spark):
    rows = [(r.doc_id, r.text, 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000, None, 1), (1001, "", 1), (None, "  ", 1), (None, "only here", 1), (3, rows[3][1], 1), (3, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = simhash.simhash_components(df).collect()
    fps = [plain_fp(r[1]) for r in rows]
    groups = plain_groups(fps, 4)
    least: dict = {}
    for r, g in zip(rows, groups):
        least[g] = min([x for x in (least.get(g), r[0]) if x is not None], default=None)
    want = [(r[0], signed(f), least[g]) for r, f, g in zip(rows, fps, groups)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id for r in kept), key=lambda v: (v is None, v or 0)) == sorted(
        least.values(), key=lambda v: (v is None, v or 0))
    assert set(map(tuple, kept)) <= set(rows)
    assert simhash.simhash_components(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), max_bits=3)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "x long, y long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
