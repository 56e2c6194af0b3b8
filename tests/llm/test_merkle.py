"""Merkle manifest against a tree built list by list."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skillgrid.llm import merkle, queries
from skillgrid.llm.common import read
from tests.conftest import SF


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(level, fanout):
    """(root, proof of each leaf: (left, right) level by level)."""
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i:i + fanout] for i in range(0, len(level), fanout)]
        for leaf, i in enumerate(at):
            run, k = runs[i // fanout], i % fanout
            proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            at[leaf] = i // fanout
        level = [h(*r) for r in runs]
    return level[0], proofs


def plain_manifest(rows, fanout=2):
    """Sorted (id, group, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], plain_leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in order}
    trees = {g: plain_tree([x[1] for x in below[g]], fanout) for g in order}
    root, tops = plain_tree([trees[g][0] for g in order], fanout)
    return sorted(((d, g, leaf, trees[g][0], root, [f"{a}:{b}" for a, b in (*trees[g][1][i], *tops[k])])
                   for k, g in enumerate(order) for i, (d, leaf) in enumerate(below[g])), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return merkle.manifest(df, **kw)


def some_rows(n, seed=1):
    r = random.Random(seed)
    return [(r.choice([None, i, i // 3, -i]), r.choice([None, "s", ""]), r.choice(["en"] * 5 + ["é", "z", None, "", "Z"]),
             r.choice([None, 0, i]), r.choice([None, "", "x" * i, "né\n"])) for i in range(n)]


@pytest.mark.parametrize("n,fanout,block", [(1, 2, 1024), (2, 2, 1024), (40, 2, 4), (300, 2, 8), (300, 3, 9), (130, 5, 30)])
def test_against_lists(spark, monkeypatch, n, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = some_rows(n, n + fanout)
    got = sorted((tuple(r) for r in run(spark, rows, fanout=fanout).collect()), key=repr)
    assert got == plain_manifest(rows, fanout)


def test_one_large_group_and_many_groups(spark):
    rows = [(i, "s", "en", i, "t") for i in range(2600)] + [(i, "s", f"g{i}", i, "t") for i in range(1300)]
    got = sorted((tuple(r) for r in run(spark, rows).collect()), key=repr)
    assert got == plain_manifest(rows)


def test_long_texts_repeated_rows_and_clashing_names(spark):
    long = "word " * 400_000
    rows = [(1, "s", "en", 5, long)] * 3 + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("tree", "pos", "digest", "n", "leaf", "proof", "group", "id")])
    got = sorted((tuple(r) for r in merkle.manifest(clash).collect()), key=repr)
    assert got == plain_manifest(rows)


def test_empty_table(spark):
    out = run(spark, [])
    assert out.count() == 0 and out.columns == ["id", "group", "leaf", "subroot", "root", "proof"]


def test_query(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    by_id = {d[0]: d for d in docs}
    want = {}
    for d, _, leaf, sub, root, proof in plain_manifest(docs):
        pairs = [p.split(":") for p in proof]
        bad = zlib.crc32(str(d).encode()) % 7 == 0
        x = by_id[d]
        fold = plain_leaf(*x[:3], x[3] + 1, x[4]) if bad else leaf
        for a, b in pairs:
            fold = h(a, fold, b)
        want[d] = (leaf, sub, root, h(*(a + b for a, b in pairs)), fold, not bad)
    got = {r[0]: tuple(r)[1:] for r in queries.op13_merkle_manifest(spark, SF).collect()}
    assert got == want and {v[-1] for v in got.values()} == {True, False}


def test_unknown_numbers_are_not_tampered_with(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, "s", "en", None, "t") for i in range(30)] + [(None, "s", "en", 3, "t")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(
        f"{folder}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, folder).collect()
    assert len(got) == 31 and all(r.verified for r in got)
