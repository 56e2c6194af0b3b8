"""Token-id files: whole texts to ids of a given tokenizer, written in compressed blocks, and read back.

Writing: texts become ids in the tasks that read them; each run of white-space
separated pieces is looked up, and words not met before are encoded by the
tokenizer.  A Python worker remembers them from task to task, so a word costs
one encoding a worker.  Documents are dealt to shards by ranges of their id,
sorted, and gathered into segments of whole documents.
Common pairs of neighbours in a segment become one symbol each, the symbols are
coded in blocks (``idcoder``), and the segment becomes one record of a file.

Record: ``HEAD``, the documents' ids, null marks and lengths, the size and
checksum of each block, the pairs, a checksum of all that, then the blocks.  Files are written
by Spark's text writer, one record a row, so any file system that Spark reaches
will do; the record's own length tells where it ends.

Reading: whole files of a few records each; every block is decoded and its
checksum compared before anything is returned.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.llm import idcoder
from skillgrid.llm.common import materialize, text_of
from skillgrid.operators.numbering import totals_before
from skillgrid.session import ensure_checkpoint_dir

MAGIC = b"IDS2"
#: magic, bits of a symbol, shard, place in the shard, documents, ids, symbols, first symbol of a pair, pairs,
#: symbols of a block, blocks, bytes after the head
HEAD = "<4sBqqqqqqqqqq"
HEAD_BYTES = struct.calcsize(HEAD)
LANES = 2048  # blocks coded at a time
BLOCK = 2048  # symbols of a block at most
LEAST_BLOCK = 256
SEGMENT = LANES * BLOCK  # ids after which a segment is closed, at a document's end
SHARD_BYTES = 16 << 20  # of text, aimed at
SEGMENTS_PER_FILE = 4
KNOWN_PIECES = 500_000  # beyond these a worker starts anew; more cost more to look through than to encode again
CHUNK = 10 << 20  # bytes of text looked up at a time
PIECES_AT_ONCE = 250_000  # turned into ids at a time
WORDS_AT_ONCE = 200  # in a text for the tokenizer
LEARNED_AT_ONCE = 50_000  # strings

#: a tokenizer with these rules splits words from marks and folds case
FOLDING = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: in character classes: letters that are single in NFC, and with them printable ASCII without ' and <
LETTERS = "a-zÀ-ÖØ-öø-ÿ"
PLAIN = "!-&(-;=-~À-ÖØ-öø-ÿ"


class Known:
    """Ids of the strings met before.  ``learn`` gives the ids of new ones and how many belong to each."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.strings = pa.array([], pa.string())
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, strings: pa.Array) -> np.ndarray:
        """Where each string stands; new ones are learned first."""
        if not len(strings):
            return np.zeros(0, np.int64)
        coded = pa.chunked_array([self.strings, strings]).dictionary_encode()  # the known ones keep their places
        last = coded.chunk(coded.num_chunks - 1)
        new = last.dictionary.slice(len(self.strings))
        if len(new):
            ids, sizes = self.learn(new)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, ids])
            self.strings = last.dictionary
        return last.indices.to_numpy()

    def ids_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these places in turn, how many belong to each)."""
        sizes = self.size[places]
        total = np.cumsum(sizes)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.repeat(self.start[places] - total + sizes, sizes) + np.arange(n)], sizes


class Encoder:
    """Ids of texts by a tokenizer whose pieces end at white space.

    ``by_piece`` is False for a tokenizer that joins words across white space;
    its texts are encoded whole.

    A tokenizer that folds case and splits by ``SPLITTING`` gives a run of letters
    the same ids whatever stands around it.  Its pieces of ``PLAIN`` characters
    (no apostrophe, no added token, nothing that composes) are cut into runs of
    letters and of others, so a word costs one encoding with any mark or capital.
    """

    def __init__(self, definition: str, by_piece: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self.tokenizer, self.by_piece = Tokenizer.from_str(definition), by_piece
        rules = json.loads(definition)
        suffix = rules["model"].get("end_of_word_suffix")
        self.splits = bool(suffix) and rules.get("normalizer") == FOLDING and rules.get("pre_tokenizer") == SPLITTING and all(
            "<" in t["content"] for t in rules.get("added_tokens") or [])
        if self.splits:
            self.model = self.tokenizer.model
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.pieces, self.parts = Known(self._pieces), Known(self._parts)

    def _whole(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        new = self.tokenizer.encode(strings.to_pylist(), is_pretokenized=True, add_special_tokens=False)
        owner = np.array(new.word_ids, np.int64) if len(new.ids) else np.zeros(0, np.int64)
        return np.array(new.ids, np.int32), np.bincount(owner, minlength=len(strings))

    def _words(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, many in a text; each gives one part, whose last id ends a word."""
        words = strings.to_pylist()
        texts = [" ".join(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.array([i for t in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in t.ids], np.int32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or last[-1] != len(ids) - 1:
            return self._whole(strings)
        return ids, np.diff(last, prepend=-1)

    @staticmethod
    def _both(strings: pa.Array, fits: pa.Array, one: Callable, other: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids by ``one`` where ``fits``, else by ``other``, in the order of the strings."""
        if pc.all(fits).as_py():
            return one(strings)
        mask = fits.to_numpy(zero_copy_only=False)
        both = Known(None)
        got = [one(strings.filter(fits)), other(strings.filter(pc.invert(fits)))] if mask.any() else [other(strings)]
        both.ids = np.concatenate([ids for ids, _ in got])
        both.size = np.concatenate([sizes for _, sizes in got])
        both.start = np.cumsum(both.size) - both.size
        places = np.empty(len(mask), np.int64)
        places[np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])] = np.arange(len(mask))
        return both.ids_at(places)

    def _ascii(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Runs of a to z, which normalising and splitting leave as they are: straight to the tokenizer's model."""
        tokenize, ids, sizes = self.model.tokenize, [], []
        for w in strings.to_pylist():
            tokens = tokenize(w)
            sizes.append(len(tokens))
            ids += [t.id for t in tokens]
        return np.array(ids, np.int32), np.array(sizes, np.int64)

    def _others(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._both(strings, pc.match_substring_regex(strings, f"^[{LETTERS}]+$"), self._words, self._whole)

    def _parts(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for a in range(0, len(strings), LEARNED_AT_ONCE):
            some = strings.slice(a, LEARNED_AT_ONCE)
            got.append(self._both(some, pc.match_substring_regex(some, "^[a-z]+$"), self._ascii, self._others))
        ids, sizes = zip(*got)
        return np.concatenate(ids), np.concatenate(sizes)

    def _split(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(
            pc.ascii_lower(strings), f"([^{LETTERS}]+)", r" \1 "))
        ids, sizes = self.parts.ids_at(self.parts.places(cut.flatten()))
        before = np.concatenate([[0], np.cumsum(sizes)])[cut.offsets.to_numpy()]
        return ids, np.diff(before)

    def _pieces(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.splits:
            return self._whole(strings)
        return self._both(strings, pc.match_substring_regex(strings, f"^[{PLAIN}]+$"), self._split, self._whole)

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Ids of each text of a binary array, ``end_id`` last."""
        end = np.array([end_id], np.int32)
        if not self.by_piece:
            for t in texts:
                yield np.concatenate([np.array(self.tokenizer.encode(
                    t.as_py().decode(), add_special_tokens=False).ids, np.int32), end])
            return
        words = pc.ascii_split_whitespace(texts.cast(pa.string()))
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        at = self.pieces.places(words.flatten())
        lo = 0
        while lo < len(texts):  # some documents at a time
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + PIECES_AT_ONCE, "right")) - 1)
            out, sizes = self.pieces.ids_at(at[bounds[lo]:bounds[hi]])
            cut = np.concatenate([[0], np.cumsum(sizes)])[bounds[lo:hi + 1] - bounds[lo]]
            for a, b in zip(cut[:-1], cut[1:]):
                yield np.concatenate([out[a:b], end])
            lo = hi
        if self.splits or len(self.pieces.strings) > KNOWN_PIECES:  # cutting a piece again costs less than keeping it
            self.pieces = Known(self._pieces)
        if len(self.parts.strings) > KNOWN_PIECES:
            self.parts = Known(self._parts)


def segment_bytes(shard: int, place: int, docs: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    """One record of whole documents."""
    lengths = np.array([len(x) for x in ids], np.int64)
    whole = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    base = int(whole.max(initial=0)) + 1
    flat, pairs = idcoder.join_pairs(whole, base)
    bits = max(bits, idcoder.id_bits(base + len(pairs)))
    block = min(BLOCK, max(LEAST_BLOCK, -(-len(flat) // LANES)))
    n = -(-len(flat) // block)
    rows = np.zeros(n * block, np.int32)
    rows[:len(flat)] = flat
    rows = rows.reshape(n, block)
    parts: list[bytes] = []
    for a in range(0, n, LANES):
        parts += idcoder.encode(rows[a:a + LANES], bits)
    sums = np.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], "<u4")
    known = np.array([d is not None for d in docs], np.uint8)
    table = b"".join((np.array([d or 0 for d in docs], "<i8").tobytes(), known.tobytes(), lengths.astype("<i8").tobytes(),
                      np.array([len(p) for p in parts], "<u4").tobytes(), sums.tobytes(), pairs.astype("<u2").tobytes()))
    rest = table + b"".join(parts)
    head = struct.pack(HEAD, MAGIC, bits, shard, place, len(docs), len(whole), len(flat), base, len(pairs), block, n,
                       len(rest))
    return head + struct.pack("<I", zlib.crc32(head + table)) + rest


def read_segments(content: bytes, end: bytes = b"\n") -> Iterator[tuple[int, int, list[int | None], list[np.ndarray]]]:
    """(shard, place, document ids, their token ids) of the records of a file; a wrong byte raises."""
    at = 0
    while at < len(content):
        head = content[at:at + HEAD_BYTES]
        if len(head) < HEAD_BYTES or head[:4] != MAGIC:
            raise ValueError(f"no token-id record at byte {at}")
        _, bits, shard, place, n_docs, n_ids, n_symbols, base, n_pairs, block, n, size = struct.unpack(HEAD, head)
        begin = at + HEAD_BYTES + 4
        rest = memoryview(content)[begin:begin + size]
        if len(rest) != size or content[begin + size:begin + size + len(end)] != end:
            raise ValueError(f"record at byte {at} is cut off")
        told = 17 * n_docs + 8 * n + 4 * n_pairs
        if zlib.crc32(head + bytes(rest[:told])) != struct.unpack("<I", content[begin - 4:begin])[0]:
            raise ValueError(f"the table of the record at byte {at} does not match its checksum")
        docs = np.frombuffer(rest[:8 * n_docs], "<i8")
        known = np.frombuffer(rest[8 * n_docs:9 * n_docs], np.uint8)
        lengths = np.frombuffer(rest[9 * n_docs:17 * n_docs], "<i8")
        sizes = np.frombuffer(rest[17 * n_docs:17 * n_docs + 4 * n], "<u4").astype(np.int64)
        sums = np.frombuffer(rest[17 * n_docs + 4 * n:17 * n_docs + 8 * n], "<u4")
        pairs = np.frombuffer(rest[17 * n_docs + 8 * n:told], "<u2").reshape(-1, 2)
        cut = told + np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros((n, block), np.int32)
        for a in range(0, n, LANES):
            b = min(n, a + LANES)
            ids[a:b] = idcoder.decode([bytes(rest[cut[i]:cut[i + 1]]) for i in range(a, b)], block, bits)
        wrong = [i for i in range(n) if zlib.crc32(ids[i].astype("<u4").tobytes()) != sums[i]]
        if wrong:
            raise ValueError(f"block {wrong[0]} of the record at byte {at} does not match its checksum")
        flat = idcoder.part_pairs(ids.reshape(-1)[:n_symbols], base, pairs)
        if len(flat) != n_ids:
            raise ValueError(f"the record at byte {at} holds {len(flat)} ids, not {n_ids}")
        yield shard, place, [int(d) if k else None for d, k in zip(docs, known)], np.split(flat, np.cumsum(lengths)[:-1]) \
            if n_docs else []
        at = begin + size + len(end)


def _cuts(docs: DataFrame, text_col: str) -> list[int]:
    """First ids of the shards after the first: even steps through ids chosen by hash, a few for each shard."""
    size, rows = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.count(F.lit(1))).first()
    shards = max(1, -(-(size or 0) // SHARD_BYTES))
    if shards == 1:
        return []
    one_in = max(1, rows // (64 * shards))
    sample = sorted(r[0] for r in docs.where(
        F.col("_id").isNotNull() & (F.pmod(F.xxhash64("_id"), F.lit(one_in)) == 0)).select("_id").toLocalIterator())
    return sorted({sample[i * len(sample) // shards] for i in range(1, shards)}) if sample else []


def write_ids(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
              by_piece: bool = True) -> None:
    """Write the ids of every whole text, ``end_id`` last, into token-id files in the folder ``path``.

    ``tokenizer`` is the path of a definition that the driver can open; it
    travels to the tasks with the job.  Documents follow each other by
    ascending id, those without one first; equal ids are in the order of their
    ids' bytes, so repeated rows give the same files.  A null or empty text is
    ``end_id`` alone.  A text of any length stays whole in one segment.  An
    empty table gives a folder without records.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer, encoding="utf-8") as f:
        shared = sc.broadcast({"definition": f.read()})  # a worker keeps its encoder in its own copy
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    cuts = _cuts(src, "_text")

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "encoder" not in held:
            held["encoder"] = Encoder(held["definition"], by_piece)
        encoder = held["encoder"]
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(size) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                some = b.slice(lo, hi - lo)
                at = pc.fill_null(some.column(0), -(1 << 63)).to_numpy(zero_copy_only=False)
                got = [x.astype("<u4") if x.size and int(x.max()) > 65535 else x.astype("<u2")
                       for x in encoder.encode(some.column(1), end_id)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(np.array(cuts, np.int64), at, "right").astype(np.int64)), some.column(0),
                     pa.array([x.dtype.itemsize for x in got], pa.int32()), pa.array([x.tobytes() for x in got], pa.binary())],
                    ["shard", "id", "width", "ids"])

    def to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        held.pop("encoder", None)  # its memory is of use here
        if "vocabulary" not in held:
            from tokenizers import Tokenizer
            held["vocabulary"] = max(Tokenizer.from_str(held["definition"]).get_vocab().values(), default=0) + 1
        bits = idcoder.id_bits(max(end_id + 1, held["vocabulary"]))
        shard, place, names, ids, n_held = None, 0, [], [], 0

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment_bytes(shard, place, names, ids, bits)], pa.binary())], ["value"])

        for b in batches:
            for s, d, w, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if names and (s != shard or n_held >= SEGMENT):
                    yield record()
                    place, names, ids, n_held = place + 1, [], [], 0
                if s != shard:
                    shard, place = s, 0
                mine = np.frombuffer(x.as_buffer(), "<u2" if w == 2 else "<u4").astype(np.int32)
                names.append(d)
                ids.append(mine)
                n_held += len(mine)
        if names:
            yield record()

    rows = src.mapInArrow(to_ids, "shard long, id long, width int, ids binary")
    dealt = rows.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "id", "ids")
    (dealt.mapInArrow(to_segments, "value binary").select(F.col("value").cast("string"))
     .write.mode("overwrite").option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, place, id, ids): every document of the files in ``path`` with its token ids."""
    return _read(spark, path, False)


def _read(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for shard, segment, docs, ids in read_segments(content.as_buffer().to_pybytes()):
                    n = np.array([len(x) for x in ids], np.int64)
                    if digest:
                        tail = [pa.array(n), pa.array(np.cumsum(n) - n),
                                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                    else:
                        tail = [pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(docs), pa.int64()), pa.array([segment] * len(docs), pa.int64()),
                         pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64()), *tail],
                        ["shard", "segment", "place", "id", *(("n", "before", "crc") if digest else ("ids",))])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "shard long, segment long, place long, id long, "
                            + ("n long, before long, crc long" if digest else "ids array<int>"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, shard, segment, place) of every document of the files in ``path``.

    ``start`` counts the ids of all documents before it: inside its segment,
    then the segments before it in its shard, then the shards before that.
    """
    docs = materialize(spark, _read(spark, path, True), "token_documents")
    segments = docs.groupBy("shard", "segment").agg(F.sum("n").alias("n"))
    shards = totals_before(segments.groupBy("shard").agg(F.sum("n").alias("n")), "shard", "n", "shard_start")
    starts = totals_before(segments, "segment", "n", "segment_start", by=("shard",)).join(
        shards.select("shard", "shard_start"), "shard").select(
        "shard", "segment", (F.col("segment_start") + F.col("shard_start")).alias("from"))
    return docs.join(starts, ["shard", "segment"]).select(
        "id", (F.col("from") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"),
        "shard", "segment", "place")


def write_and_read(docs: DataFrame, *, tokenizer: str, **names) -> DataFrame:
    """Write ``docs`` as token-id files in the shared folder and return the index made from them."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex[:12]}"
    write_ids(docs, path, tokenizer=tokenizer, **names)
    return token_index(spark, path)
