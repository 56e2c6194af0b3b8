"""Repeated byte strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skillgrid.llm import suffixes
from tests.conftest import SF


def plain(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, span, gram, parts=3):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffixes.remove_repeats(df.repartition(parts), span=span, gram=gram).collect()}
    want = plain(texts, span)
    assert [got[i] for i in range(len(texts))] == want


def test_random_texts(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é\n") for _ in range(90)) for _ in range(6)]
    texts = [None, "", "aaaa", "a" * 150, "ab" * 60, "a" * 40]
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i, j = sorted(rng.sample(range(91), 2))
        texts.append("".join(rng.choice("abcdef") for _ in range(rng.randrange(20))) + a[i:j] + b[:rng.randrange(60)])
    texts += [texts[-1], texts[-1], base[0] + base[0]]
    check(spark, texts, 20, 6)


def test_runs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_BYTES", 300)
    monkeypatch.setattr(suffixes, "RANGE_SUFFIXES", 5)
    monkeypatch.setattr(suffixes, "CELLS", 64)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(120)) for _ in range(3)]
    texts = [b[:rng.randrange(30, 120)] + rng.choice("xyz") + b[rng.randrange(60):] for b in base * 12]
    check(spark, texts, 24, 8)


def test_frequent_grams_are_split(spark, monkeypatch):
    """One line in all texts, with own, shared and repeated surroundings, in groups by the bytes around its k-grams."""
    monkeypatch.setattr(suffixes, "HOT_GRAM", 3)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 2000)
    monkeypatch.setattr(suffixes, "RANGE_SUFFIXES", 20)
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefgh") for _ in range(30))
    ends = ["".join(rng.choice("xyz") for _ in range(40)) for _ in range(4)]
    texts = [rng.choice(ends)[rng.randrange(40):] + line + rng.choice(ends)[:rng.randrange(40)] for _ in range(60)]
    texts += [line, line * 3, "q" * 90, "q" * 70, *texts[:5]]
    check(spark, texts, 40, 10)
    check(spark, texts, 25, 8)


def test_pieces_cover_each_start_once():
    raw = bytes(range(256)) * 8
    for far, near in ((0, 0), (304, 0), (200, 37), (38, 38), (76, 75)):
        got = list(suffixes._pieces(raw, 5, 500, far, near, 400, 96))
        assert sorted(d for _, f, n in got for d in range(n, f + 1)) == list(range(near, far + 1))
    # same bytes around the anchor, same group, whatever the range of starts
    one = {n // 39: g for g, _, n in suffixes._pieces(raw, 5, 500, 304, 0, 400, 96)}
    two = {n // 39: g for g, _, n in suffixes._pieces(raw, 5, 756, 250, 20, 400, 96)}
    assert all(one[k] == g for k, g in two.items()) and len(two) == 7


@pytest.mark.parametrize("seed", range(4))
def test_any_order_of_rows_and_runs(monkeypatch, seed):
    """Runs cut from rows in any order, in runs of any content, give the same spans."""
    monkeypatch.setattr(suffixes, "RUN_BYTES", 250)
    rng = random.Random(1)
    base = ["".join(rng.choice("abcd") for _ in range(60)) for _ in range(3)]
    raw = [b.encode() for b in base * 4 + [base[0][:45], base[1][5:]]]
    which, at, first, last, kh = suffixes.Anchors(24, 8)(raw)
    places = suffixes._pack_place(at, first, last)
    order = list(range(len(raw)))
    random.Random(seed).shuffle(order)
    batches = [pa.RecordBatch.from_arrays([
        pa.array([bytes([i]) * 16]), pa.array([raw[i].decode()]), pa.array([kh.view(np.int64)[which == i]]),
        pa.array([places[which == i]]), pa.array([[bool(seed % 2)] * int((which == i).sum())])],
        ["rk", "body", "kh", "place", "hot"]) for i in order]
    runs = pa.Table.from_batches(suffixes._sorted_runs(24, 8, 1)(iter(batches)))
    spans = suffixes._merge(24, 8)((0,), runs).to_pylist()
    gone = [bytearray(len(r)) for r in raw]
    for x in spans:
        gone[x["rk"][0]][x["start"]:x["end"]] = b"\1" * (x["end"] - x["start"])
    seen = Counter(r[i:i + 24] for r in raw for i in range(len(r) - 23))
    for r, g in zip(raw, gone):
        want = bytearray(len(r))
        for i in range(len(r) - 23):
            if seen[r[i:i + 24]] > 1:
                want[i:i + 24] = b"\1" * 24
        assert g == want


def test_corpus(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts, 400, 96)


def test_empty_and_repeated_rows(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "abc" * 200), (1, "abc" * 200), (None, "q" * 399)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    assert got == [(399, 0), (600, 600), (600, 600)]


def test_repeated_rows_carry_one_list_of_anchors(spark, monkeypatch):
    lists = {}

    def keep(s, df, name):
        lists[name] = df.collect()
        return s.createDataFrame(lists[name], df.schema)
    monkeypatch.setattr(suffixes, "materialize", keep)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(1500))
    suffixes.repeated_spans(spark.createDataFrame([(1, text)] * 20, "doc_id long, text string")).collect()
    _, at, *_ = suffixes.Anchors(400, 96)([text.encode()])
    assert [len(r.place) for r in lists["anchor_lists"]] == [len(at)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_prefix_merge(k):
    rng = random.Random(k)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(12)))
            for _ in range(k)]
    coded = [iter(list(zip(suffixes._lcp(r), r)) if r else []) for r in runs]
    out = list(suffixes.PrefixMerge(coded))
    assert [x for *_, x in out] == sorted(x for r in runs for x in r)
    for (_, _, a), (s, _, b) in zip(out, out[1:]):
        assert s == suffixes.shared_prefix(a, b)


def test_merge_groups_are_even():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes() for _ in range(4)]
    which, at, first, last, kh = suffixes.Anchors(400, 96)(texts)
    places = suffixes._pack_place(at, first, last)
    batch = pa.RecordBatch.from_arrays([
        pa.array([bytes([i]) * 16 for i in range(4)]), pa.array([t.decode() for t in texts]),
        pa.array([kh.view(np.int64)[which == i] for i in range(4)]), pa.array([places[which == i] for i in range(4)]),
        pa.array([[False] * int((which == i).sum()) for i in range(4)])], ["rk", "body", "kh", "place", "hot"])
    sizes = np.zeros(20, np.int64)
    for b in suffixes._sorted_runs(400, 96, 20)(iter([batch])):
        for part, owners in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
            sizes[part] += len(owners) // 16
    assert sizes.sum() == len(at) and sizes.max() < 2 * sizes.mean()
