"""Line dedup and quality rules against plain versions."""

import hashlib
import math
from collections import Counter

import pytest
import xxhash

from skillgrid.llm import line_dedup, quality_rules
from tests.conftest import SF

SPACE = " \t\n\x0b\x0c\r"
TEXTS = [None, "", "\n", "a\nb\n a \nA", " \x0bx\t\nÉ\né", "b\nb\nc", "c\r\nb", "\n\n", "q" * 5000 + "\n" + "b\n" * 500,
         "É", "a", "a", "a b \n"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_lines(texts, least):
    split = [(t or "").split("\n") for t in texts]
    keys = [[lower(x).strip(SPACE) for x in ls] for ls in split]
    seen = Counter(k for ks in keys for k in set(ks))
    out = []
    for ls, ks in zip(split, keys):
        kept = [x for x, k in zip(ls, ks) if not (len(k) >= 1 and seen[k] >= least)]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rows = [(None if i == 3 else i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(1, "a", "x", 7), (1, "a", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_lines long").repartition(3)
    got = line_dedup.line_dedup(df, min_docs=3).collect()
    want = plain_lines([r[1] for r in rows], 3)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=key) == sorted(
        ((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert got[0].gone == "x"
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs, min_docs=10).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], plain_lines([r.text for r in rows], 10)))


def words(t):
    return (t or "").translate({ord(c): " " for c in SPACE}).split(" ") if t else []


def plain_rules(t, ratios):
    t = t or ""
    w = [x for x in words(t) if x]
    wins = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if wins[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    sign = lambda h: h - (1 << 64) if h >> 63 else h
    first = lambda x, s: xxhash.xxh64_intdigest(x.encode(), s)
    grams = [sign(first(x, 42)) % len(ratios) for x in w]
    grams += [sign(first(b, first(a, 42))) % len(ratios) for a, b in zip(w, w[1:])]
    score = sum(ratios[g] for g in grams) / max(1, 2 * len(w) - 1) if w else 0.0
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed), score


def test_quality_rules(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, "a b c " * 40, "a b c d " * 3, " ".join(f"w{i}" for i in range(99)),
                                                " ".join(f"w{i % 90}" for i in range(400)), "#a *b\n#a *b\n\n \n#a *b"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ratios = quality_rules.bucket_log_ratios(docs, spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), buckets=64)
    for frame in (df, docs):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in quality_rules.quality_rules(frame, ratios, min_score=0.0).collect():
            base, score = plain_rules(texts[r.doc_id], ratios)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
            assert r.llr_score == pytest.approx(score, abs=1e-9)
            assert r.kept == (not base[-1] and r.llr_score >= 0.0)
    assert quality_rules.quality_rules(df.limit(0), ratios).count() == 0


def test_log_ratios(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (None, "c c"), (4, None)], "doc_id long, text string")
    got = quality_rules.bucket_log_ratios(docs, spark.createDataFrame([(1,), (9,)], "doc_id long"), buckets=8, alpha=1.0)
    assert len(got) == 8 and min(got) < 0 < max(got)
    # 3 n-grams of the trusted text among 3 + 1 + 3 of all
    assert math.fsum(math.exp(x) for x in got) > 0
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.bucket_log_ratios(docs, none, buckets=8) == [0.0] * 8


def test_registered_digest(spark):
    from skillgrid.llm import queries
    got = {r.doc_id: r.kept_sha256 for r in queries.op1_line_dedup(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_lines([r.text for r in rows], 10)
    assert got == {r.doc_id: hashlib.sha256(w[2].encode()).hexdigest() for r, w in zip(rows, want)}


@pytest.mark.parametrize("n_docs", [400, 1000])
def test_held_out_good_documents_are_kept_in_every_language(spark, n_docs):
    """Half of the good labels are left out of the counts; at two sizes, nearly all of them stay."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id < {n_docs}").select("doc_id", "text", "lang").cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(f"doc_id < {n_docs}")
    good = [r.doc_id for r in labels.where("quality = 1").select("doc_id").collect()]
    seen = {i for i in good if xxhash.xxh64_intdigest(str(i).encode()) % 2}
    trusted = spark.createDataFrame([(i,) for i in seen], "doc_id long")
    ratios, limits = quality_rules.learn(docs, trusted)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, ratios, min_score=limits).collect()}
    for lang in sorted({r.lang for r in got.values()}):
        fresh = [got[i] for i in good if i not in seen and got[i].lang == lang and not got[i].base_failed]
        assert sum(not r.kept for r in fresh) <= 1 + 0.1 * len(fresh), (lang, len(fresh))
    bad = [got[r.doc_id] for r in labels.where("quality = 0").collect()]
    caught = [not r.kept for r in bad if r.lang in limits]
    assert sum(caught) >= 0.8 * len(caught)
    docs.unpersist()
