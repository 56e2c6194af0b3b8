"""Katz scores against a plain implementation over strings."""

import math
import zlib
from collections import Counter

import pytest

from skillgrid.llm import katz
from tests.conftest import SF


def plain(rows, folds=10):
    def tokens(t):
        return [w for w in (t or "").encode().lower().split()] + [None]

    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % folds == 0 for k, _ in rows}
    uni, bi, ctx = Counter(), Counter(), Counter()
    for k, t in rows:
        if not held[k]:
            before = "start"
            for w in tokens(t):
                uni[w] += 1
                bi[before, w] += 1
                ctx[before] += 1
                before = w
    n = sum(uni.values())

    def factors(counts):
        have = Counter(counts.values())
        return katz.discounts([0] + [have[r] for r in range(1, katz.DISCOUNTED + 2)])

    def d(f, c):
        return f[c] if c <= katz.DISCOUNTED else 1.0

    fu, fb = factors(uni), factors(bi)
    left = sum((1 - d(fu, c)) * c for c in uni.values()) / n if n else 1.0
    total = n
    if left <= 0:
        fu, left, total = [1.0] * 9, 1 / (n + 1), n + 1

    def p1(w):
        return d(fu, uni[w]) * uni[w] / total if uni[w] else left

    follow = {}
    for (h, w), c in bi.items():
        follow.setdefault(h, []).append((w, c))
    base, alpha = {}, {}
    for h, ws in follow.items():
        rest = 1 - sum(d(fb, c) * c for _, c in ws) / ctx[h]
        base[h] = ctx[h]
        if rest <= 1e-12:
            base[h], rest = ctx[h] + 1, 1 / (ctx[h] + 1)
        alpha[h] = rest / (1 - sum(p1(w) for w, _ in ws))
        # the probabilities of a context add up to 1
        rest_p = left + sum(p1(w) for w in uni if (h, w) not in bi) if len(uni) < 300 else None
        if rest_p is not None:
            assert abs(sum(d(fb, c) * c / base[h] for _, c in ws) + alpha[h] * rest_p - 1) < 1e-9
    out = []
    for k, t in rows:
        ts, s, b, before = tokens(t), 0.0, 0.0, "start"
        for w in ts:
            c = bi[before, w]
            p = d(fb, c) * c / base[before] if c else alpha.get(before, 1.0) * p1(w)
            s += math.log10(p)
            b += math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1)))
            before = w
        out.append((k, held[k], len(ts), sum(uni[w] > 0 for w in ts), n, b, s))
    return out


def check(spark, rows):
    got = katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)).collect()
    want = plain([(r[0], r[1]) for r in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)


def test_small_texts(spark):
    texts = ["a b a b c", "A B\tc", "", None, "a b c d e f g a b c", "zz yy zz", "b a", "a\x0bb\x0cc", "é É e", "a b a b c"]
    check(spark, [(i, texts[i % len(texts)], "x") for i in range(40)] + [(None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x")])


def test_corpus(spark):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows)


def test_empty_and_untrained(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    check(spark, [(alone, "a b", "x")])


def test_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5)
    check(spark, [(i, f"a b w{i % 7} c a w{i % 5}", "x") for i in range(60)])
