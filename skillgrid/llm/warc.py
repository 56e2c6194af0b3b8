"""WARC archives with revisit records, and a globally ordered capture index.

Writing: pages with equal payloads are found by digest; one is stored as a
response, the others as revisits.  A record is one text row, written with the
WARC record end as line separator, so every part file is an archive and any
file system that Spark reaches will do.  A file is gzip-compressed as a whole;
offsets in the index count uncompressed bytes.

Reading: each archive is parsed into index lines (URL key, timestamp, ...),
sorted within the archive: a run.  Runs are cut at common split keys and
exchanged; each key range merges its pieces of all runs with a loser tree.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.llm.common import materialize
from skillgrid.session import ensure_checkpoint_dir

END = "\r\n\r\n"
RECORDS_PER_FILE = 4096
LINES_PER_RANGE = 100_000  # of the merged index, aimed at
PIECE = 4096  # index lines of a run that travel as one row
INDEX = ("url_key string, timestamp string, page_id long, record_type string, payload_digest string, "
         "payload_bytes long, refers_to long, archive string, offset long, length long")


def revisits(pages: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """(page_id, digest, keeper) of the pages that are stored as revisits.

    ``pages`` has page_id, digest, size.  The keeper of a group of equal
    payloads is the largest page_id; a row without id is never a revisit.
    Groups are reduced to their keeper before the shuffle, so a payload that
    a third of all pages share is one row per task.
    """
    big = pages.where(F.col("size") >= min_bytes)
    keep = materialize(pages.sparkSession, big.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"))
                       .select("digest", "keeper"), "payload_keepers")
    return big.join(keep, "digest").where(F.col("page_id") < F.col("keeper")).select("page_id", "digest", "keeper").distinct()


def _uuid(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, *, time: Column, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 1000, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one WARC/1.1 record for each row of ``pages`` into the folder ``path``.

    ``time`` is the capture time, a timestamp (null: the epoch).  A null
    payload is empty.  Control characters in a URL are percent-coded; a null
    URL is written as an empty one.  Rows that repeat the keeper's id are
    responses like it.
    """
    src = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"),
        F.date_format(F.coalesce(time, F.lit(0).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    sized = src.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload")})
    again = revisits(sized.select("page_id", "digest", "size"), min_bytes=min_bytes)
    rows = sized.join(again.hint("shuffle_hash"), ["page_id", "digest"], "left")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    is_again = F.col("keeper").isNotNull()
    block = F.when(is_again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(F.col("page_id"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(is_again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(is_again, F.concat(F.lit("WARC-Refers-To: "), _uuid(F.col("keeper"), F.col("digest")))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(is_again, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("keeper").cast("string"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    (rows.select(F.concat(head, F.lit(END), block).alias("value")).write.mode("overwrite")
     .option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def url_key(url: str) -> str:
    """Sortable key of a URL: host labels reversed, then path and query; no scheme, default port, www or fragment."""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").rstrip("."), p.port
    except ValueError:
        return url.strip().replace(" ", "%20")
    if host.startswith("www."):
        host = host[4:]
    default = {"http": 80, "https": 443}.get(p.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (p.path or "/")
    return (key + (f"?{p.query}" if p.query else "")).replace(" ", "%20")


def records(content: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, header fields, block) of every record of an archive."""
    at, end = 0, END.encode()
    while at < len(content):
        stop = content.index(end, at)
        first, *lines = content[at:stop].split(b"\r\n")
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        begin = stop + 4
        size = int(head[b"content-length"])
        if content[begin + size:begin + size + 4] != end:
            raise ValueError(f"record at byte {at} is cut off")
        yield at, begin + size + 4 - at, head, content[begin:begin + size]
        at = begin + size + 4


def index_line(archive: str, offset: int, length: int, head: dict[bytes, bytes], block: bytes) -> bytes:
    """One line of the capture index; lines of one form sort by URL key, timestamp, then page."""
    http, _, payload = block.partition(END.encode())
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    kind = head[b"warc-type"].decode()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{archive}: payload at byte {offset} does not match its digest")
    stamp = head[b"warc-date"].decode().translate({ord(c): None for c in "-:TZ"})
    page = head.get(b"x-page-id", b"").decode()
    refers = head.get(b"x-refers-to-page-id", b"").decode()
    key = url_key(head[b"warc-target-uri"].decode("utf-8", "replace")) or "-"
    return " ".join((key, stamp, page.zfill(20) if page else "-", kind, digest, str(size), refers or "-", archive,
                     str(offset), str(length))).encode()


class LoserTree:
    """Merge of sorted lists: each inner node keeps the loser of its match, so the
    next winner is found by replaying one path, with about log2(k) comparisons."""

    def __init__(self, runs: list[list[bytes]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b)) if x is not None else False

    def _play(self, node: int) -> int:
        """Winner below ``node``; leaf i is node k + i."""
        order, winners = [], {}
        stack = [node]
        while stack:
            n = stack.pop()
            order.append(n)
            if n < self.k:
                stack += [2 * n, 2 * n + 1]
        for n in reversed(order):
            if n >= self.k:
                winners[n] = n - self.k
            else:
                a, b = winners.pop(2 * n), winners.pop(2 * n + 1)
                if self._less(b, a):
                    a, b = b, a
                winners[n], self.losers[n] = a, b
        return winners[node]

    def __iter__(self) -> Iterator[bytes]:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            n = (at + self.k) // 2
            while n >= 1 and self.k > 1:
                if self._less(self.losers[n], at):
                    self.losers[n], at = at, self.losers[n]
                n //= 2
            self.winner = at


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, piece, lines) of the archives in ``path``; a run is one archive's index, sorted, in pieces."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0), b.column(1)):
                name = archive.as_py().rpartition("/")[2]
                raw = content.as_buffer().to_pybytes()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                lines = sorted(index_line(name, *r) for r in records(raw))
                for lo in range(0, len(lines), PIECE):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name]), pa.array([lo], pa.int64()),
                        pa.array([lines[lo:lo + PIECE]], pa.list_(pa.binary()))], ["run", "piece", "lines"])

    return files.mapInArrow(run, "run string, piece long, lines array<binary>")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Capture index in global order: (range, place) and the fields of ``INDEX``.

    Ranges follow each other in key order, places are the order inside.  The
    split keys are taken from lines chosen by hash, a few for each range; they
    set how even the ranges are, never what is in them.
    """
    total = runs.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    ranges = max(1, -(-total // LINES_PER_RANGE), min(64, total // 1000))
    one_in = max(1, total // (16 * ranges))
    sample = sorted(bytes(r.line) for r in runs.select(F.explode("lines").alias("line"))
                    .where(F.pmod(F.xxhash64("line"), F.lit(one_in)) == 0).toLocalIterator())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, piece, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = 0
                while at < len(lines):
                    r = bisect.bisect_right(cuts, lines[at])
                    end = bisect.bisect_left(lines, cuts[r], at) if r < len(cuts) else len(lines)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r], pa.int32()), pa.array([name]), pa.array([piece + at], pa.int64()),
                        pa.array([lines[at:end]], pa.list_(pa.binary()))], ["range", "run", "piece", "lines"])
                    at = end

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        by_run: dict[str, list] = {}
        for name, piece, lines in zip(*(table.column(c).to_pylist() for c in ("run", "piece", "lines"))):
            by_run.setdefault(name, []).append((piece, lines))
        merged = list(LoserTree([[x for _, part in sorted(pieces) for x in part]
                                 for _, pieces in sorted(by_run.items())]))
        f = [x.decode().split(" ") for x in merged]
        num = lambda i: pa.array([None if x[i] == "-" else int(x[i]) for x in f], pa.int64())
        txt = lambda i: pa.array([x[i] for x in f], pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(f), pa.int32()), pa.array(range(len(f)), pa.int64()), txt(0), txt(1),
                         num(2), txt(3), txt(4), num(5), num(6), txt(7), num(8), num(9)],
                        names=["range", "place", *[c.split()[0] for c in INDEX.split(", ")]])

    pieces = runs.mapInArrow(cut, "range int, run string, piece long, lines array<binary>")
    return pieces.groupBy("range").applyInArrow(merge, f"range int, place long, {INDEX}")


def archive_and_index(pages: DataFrame, *, time: Column, **names) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    write_archives(pages, path, time=time, **names)
    return merge_runs(materialize(spark, sorted_runs(spark, path), "index_runs"))
