"""Token-id files: exact round trip, the tokenizer's own result, and damaged files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from skillgrid.llm import idcoder, queries, token_files
from skillgrid.llm.common import read
from tests.conftest import SF

DEFINITION = tokenizer_path("word_bpe_49k.json")


def plain(rows):
    """(id, start, n, crc) by the library alone, one text after another."""
    tok = Tokenizer.from_file(DEFINITION)
    coded = [(d, tok.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    out, start = [], 0
    for d, ids in coded:
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(rows):
    return sorted(rows, key=lambda r: r[1])


def test_query_equals_the_library(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    got = [tuple(r) for r in queries.op11_token_files(spark, SF).collect()]
    assert key(got) == plain(rows)


def test_many_shards_and_segments(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(token_files, "SEGMENT", 2_000)
    monkeypatch.setattr(token_files, "CHUNK", 5_000)
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 300)
    docs = read(spark, SF, "documents").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = token_files.write_and_read(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=DEFINITION).collect()
    assert key([tuple(r)[:4] for r in got]) == plain(rows)
    assert len({r.shard for r in got}) > 5 and len({(r.shard, r.segment) for r in got}) > len({r.shard for r in got})


def test_odd_rows(spark, tmp_path):
    long = " ".join(random.Random(3).choices(["alpha", "Béta", "x1y2", "\U0001f600", "don't", "<|endoftext|>"], k=60_000))
    rows = [(5, None), (2, ""), (None, "no id"), (None, None), (2, "tie"), (2, "tie"), (-7, " \t\n"), (9, long),
            (8, "  a　b\x1cc\x85d​e"), (7, "x" * 5000), (3, "İstanbul ΣΣ"), (4, "a\x00b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, shard string")
    out = str(tmp_path / "files")
    token_files.write_ids(df, out, tokenizer=DEFINITION)
    assert key([tuple(r)[:4] for r in token_files.token_index(spark, out).collect()]) == plain(rows)
    tok = Tokenizer.from_file(DEFINITION)
    ids = {r.id: r.ids for r in token_files.read_ids(spark, out).collect()}
    assert ids[9] == tok.encode(long, add_special_tokens=False).ids + [1] and ids[-7] == [1]


def test_whole_texts_for_other_tokenizers(spark, tmp_path):
    bpe = tokenizer_path("byte_bpe_50k.json")
    rows = [(1, "two  spaces\n\nand lines "), (2, None)]
    out = str(tmp_path / "files")
    token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), out, tokenizer=bpe, end_id=70_000, by_piece=False)
    got = {r.id: r.ids for r in token_files.read_ids(spark, out).collect()}
    assert got == {1: Tokenizer.from_file(bpe).encode(rows[0][1]).ids + [70_000], 2: [70_000]}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = token_files.write_and_read(df, tokenizer=DEFINITION)
    assert out.count() == 0 and out.columns[:4] == ["id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("lanes,steps,bits", [(1, 1, 1), (1, 700, 16), (5, 33, 8), (40, 300, 16), (3, 200, 29)])
def test_coder_round_trip(lanes, steps, bits):
    rng = np.random.default_rng(lanes * steps)
    for kind in ("any", "few", "same", "cycle"):
        n = 1 << bits
        x = {"any": lambda: rng.integers(0, n, (lanes, steps)), "few": lambda: rng.integers(0, min(n, 6), (lanes, steps)),
             "same": lambda: np.full((lanes, steps), n - 1),
             "cycle": lambda: np.arange(lanes * steps).reshape(lanes, steps) % min(n, 17)}[kind]()
        parts = idcoder.encode(x, bits)
        assert (idcoder.decode(parts, steps, bits) == x).all()
        for i in (0, lanes - 1):  # a block does not need the others
            assert (idcoder.decode([parts[i]], steps, bits)[0] == x[i]).all()


def test_coder_learns_its_orders():
    rng = np.random.default_rng(1)
    size = lambda x: 8 * len(idcoder.encode(x[None], 16)[0]) / len(x)
    n = 2048
    order0 = rng.choice([7, 900, 31000, 12], n, p=[.7, .1, .1, .1])
    order1 = np.zeros(n, int)
    follow = rng.permutation(500)
    for i in range(1, n):
        order1[i] = follow[order1[i - 1]]
    order2 = np.tile([1, 2, 1, 3, 2, 3], n // 6 + 1)[:n]
    uniform = rng.integers(0, 1 << 16, n)
    assert size(order0) < 7 and size(order1) < 6 and size(order2) < 1.5 and 16 < size(uniform) < 17


def test_damage_is_found():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 40000, n).astype(np.int32) for n in (300, 1, 4000)]
    record = token_files.segment_bytes(3, 1, [4, None, 9], ids, 16) + b"\n"
    (shard, place, docs, back), = token_files.read_segments(record)
    assert (shard, place, docs) == (3, 1, [4, None, 9]) and all((a == b).all() for a, b in zip(ids, back))
    for at in (0, 30, token_files.HEAD_BYTES + 1, token_files.HEAD_BYTES + 20, len(record) // 2, len(record) - 400, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 0x41
        with pytest.raises((ValueError, MemoryError, OverflowError)):
            list(token_files.read_segments(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_files.read_segments(record[:-5]))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5_000, 300_000])
def test_pairs_part_again(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 60, 50_000, 65_535, 65_536, 1 << 20):
        ids = np.minimum(rng.geometric(0.05, n) - 1, top - 1).astype(np.int32)
        ids[n // 2:n // 2 + 3], ids[-1:] = 0, top - 1
        symbols, pairs = idcoder.join_pairs(ids, top)
        assert (idcoder.part_pairs(symbols, top, pairs) == ids).all()
        if n > 5_000 and top in (60, 50_000):  # common pairs leave less to code
            assert len(symbols) < 0.7 * n and top + len(pairs) <= 1 << 16


def test_a_word_is_encoded_once_whatever_surrounds_it(monkeypatch):
    """Before, each of these pieces was an encoding of its own, and anew in each task."""
    encoder = token_files.Encoder(open(DEFINITION, encoding="utf-8").read())
    given = []
    parts = token_files.Encoder._parts
    encoder.parts = token_files.Known(lambda strings: (given.extend(strings.to_pylist()), parts(encoder, strings))[1])
    texts = ["Word word, WORD. (word) word&&&", "word! word_word été Été,", "word 12 word"]
    tok = Tokenizer.from_file(DEFINITION)
    for _ in range(2):
        got = list(encoder.encode(pa.array([t.encode() for t in texts], pa.binary()), 1))
        assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert given.count("word") == 1 and len(given) == len(set(given))


def test_characters_that_change_a_split(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 500)
    monkeypatch.setattr(token_files, "PIECES_AT_ONCE", 50)
    monkeypatch.setattr(token_files, "LEARNED_AT_ONCE", 100)
    rng = random.Random(8)
    chars = [*"abAB'<>|.,!$&#*%0129çÇéÉßÿµªº×÷İΣσςſKǺ̈ゔ한ᄀ가क़٣²½\u00ad\u200b\x85\xa0\u2028\x1c\x00\x7f😀",
             "e\u0301", "'s", "'T", "'LL", "<|endoftext|>", "<|startoftext|>", "don't", "l'été", " ", " ", "\n", "\t "]
    texts = ["".join(rng.choices(chars, k=rng.randrange(40))) for _ in range(2_000)]
    tok = Tokenizer.from_file(DEFINITION)
    encoder = token_files.Encoder(open(DEFINITION, encoding="utf-8").read())
    for a in range(0, len(texts), 400):
        got = list(encoder.encode(pa.array([t.encode() for t in texts[a:a + 400]], pa.binary()), 1))
        assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts[a:a + 400]]
