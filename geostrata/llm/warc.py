"""WARC archives written and read back by Spark, and their capture index merged by loser trees.

Every row becomes one WARC/1.1 record in a gzip member of its own, so that a record can be read from its offset alone. Archives are
written by Spark's own text writer, to any store that Spark can write to, without a driver or a local disk in between: a member's
bytes are the line, and an empty member is the line separator. Archives are read as whole files, member by member.

The capture index is merged externally: each file's captures, sorted by URL key and timestamp, are a run, and the runs lie on
shared files. They are cut at common boundaries into ranges of about RANGE_ROWS captures, however many runs there are, and the
task that owns a range merges its pieces of all runs with a loser tree into globally ordered capture histories.

Defined results: null html counts as empty, null url as an empty URI, null ids are written as an empty id and read back as null.
Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the response and the others are
revisits of it; a null id is never the smallest unless all are null, then all are responses. Smaller payloads are all responses.
Rows repeated with the same id are all responses. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only, saved, scratch, slices, utf8

CRLF = "\r\n"
#: Records and compressed bytes of a bundle at most, unless it is one record, and bundles of an archive file. A reader holds one file's
#: compressed bytes and one record.
BUNDLE_RECORDS, BUNDLE_BYTES, FILE_BUNDLES = 250, 16 << 20, 4
#: Captures in one range of the index, about: what a task holds when it merges.
RANGE_ROWS = 50_000
#: A gzip member without content.
EMPTY = gzip.compress(b"", mtime=0)
#: The captures' time: the tables have none, so record number n of a URL counts seconds from here.
EPOCH = "2024-01-01T00:00:00Z"


def _digests(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        data = data.tobytes()
        digests = [base64.b32encode(hashlib.sha1(data[a:b]).digest()).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.string()), pa.array(offsets[1:] - offsets[:-1], pa.int64())], ["id", "url", "html", "digest", "size"])


def _no_breaks(column):
    """A header value on one line: control characters are percent-encoded, as a URI has to."""
    out = F.replace(F.coalesce(column, F.lit("")), F.lit("%"), F.lit("%25"))
    for c in "\r\n":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, epoch: str = EPOCH) -> None:
    """Writes ``df`` as WARC files, one gzip member a record, below ``path``. Record times count seconds from ``epoch`` by the id.

    Which records are revisits is found from ids and digests. That list then meets the pages by a join: where it is small it is
    broadcast by Spark's own choice, else it moves the pages once.
    """
    pages = only(df, id=id_col, url=url_col, html=html_col).mapInArrow(_digests, "id long, url string, html string, digest string, size long")
    captures = saved(pages.select("id", "digest", "size"), "captures")
    firsts = captures.where(f"size >= {int(min_bytes)}").groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    kinds = saved(captures.join(firsts, "digest").where("id > first_id").where(f"size >= {int(min_bytes)}").select("id", "digest", "first_id").distinct(), "revisits")
    rows = pages.join(kinds, ["id", "digest"], "left")
    revisit = F.col("first_id").isNotNull()
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(epoch))) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))
    urn = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    heads = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", urn(F.col("id"))), ("WARC-Date", date), ("WARC-Target-URI", _no_breaks(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Payload-Length", F.col("size").cast("string")), ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    text = F.concat(F.lit(f"WARC/1.1{CRLF}"), *(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in heads), F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), urn(F.col("first_id")), F.lit(CRLF))).otherwise(""), F.lit(CRLF), block)
    lines = rows.select(text.alias("record")).mapInArrow(_compressed, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", FILE_BUNDLES).text(path)


def _compressed(batches):
    """Bundles of records, each with the empty lines at its end as a gzip member, and an empty member between two."""
    held, size = [], 0
    for batch in batches:
        for piece in slices([batch], 0):
            for text in piece.column(0).to_pylist():
                member = gzip.compress(text.encode() + b"\r\n\r\n", mtime=0)
                if held and (len(held) >= BUNDLE_RECORDS or size + len(member) > BUNDLE_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([EMPTY.join(held)], pa.binary())], ["value"])
                    held, size = [], 0
                held.append(member)
                size += len(member)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([EMPTY.join(held)], pa.binary())], ["value"])


def members(data) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of a file that are not empty."""
    at = 0
    while at < len(data):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof:
            if end >= len(data):
                raise ValueError(f"the member at {at} has no end")
            parts.append(member.decompress(data[end : end + (1 << 16)]))
            end += 1 << 16
        end = min(end, len(data)) - len(member.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (without the HTTP head) of one record, found by their lengths."""
    end = content.index(b"\r\n\r\n")
    heads = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in content[:end].decode().split(CRLF)[1:])
    size = int(heads["Content-Length"])
    if len(content) != end + 4 + size + 4:
        raise ValueError("a record's length is not that of its header")
    block = content[end + 4 : end + 4 + size]
    return heads, block[block.index(b"\r\n\r\n") + 4 :]


def url_key(url: str) -> str:
    """The URL's sort key: host labels reversed, without scheme, port 80 or 443 and fragment, in lower case but for the path."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower().removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (slash or "/") + path


_INDEX = "url_key string, time string, id long, url string, offset long, length long, size long, digest string, kind string, refers_to long, run string"


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, each file's rows sorted: the runs of the capture index.

    A response's payload is hashed again, and a digest or length that differs from its header fails the read.
    """

    def parse(batches):
        number = lambda urn: int(urn[len("<urn:capture:") : -1]) if len(urn) > len("<urn:capture:>") else None
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                for at, length, raw in members(memoryview(content.as_buffer())):
                    h, payload = record(raw)
                    url, digest, size = h["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["Payload-Length"])
                    if h["WARC-Type"] == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                        raise ValueError(f"damaged record at {at} of {name}")
                    out.append((url_key(url), h["WARC-Date"], number(h["WARC-Record-ID"]), url, at, length, size, digest, h["WARC-Type"], number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, name))
                out.sort(key=_order)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, _INDEX)


_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in _INDEX.split(", ")]


def _order(row: tuple):
    """What captures are ordered by: URL key, time, id with null last, archive and offset."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[-1], row[4]


class LoserTree:
    """Merges k sorted iterators: every inner node keeps the loser of its match, so a step replays one leaf-to-root path."""

    def __init__(self, runs):
        self.runs = [iter(x) for x in runs]
        self.heads = [next(x, None) for x in self.runs]
        self.keys = [None if x is None else _order(x) for x in self.heads]
        self.k = len(self.runs)
        self.losers = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[b] is None or self.keys[a] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # while the tree is built, the first to arrive waits here
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = row = next(self.runs[winner], None)
            self.keys[winner] = None if row is None else _order(row)
            self._play(winner)


def merge_runs(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The runs merged into one order by URL key and time: the index's columns, in ranges whose partitions follow each other.

    The number of ranges follows from that of the captures, and their boundaries from a sample of (URL key, time, id, archive,
    offset), which no two captures share: so a range has about ``range_rows`` rows, captures of one hot URL, or of one page that is
    repeated, spread over ranges, and a task holds the pieces of one range only.
    """
    partitions = max(1, -(-index.count() // range_rows))

    def merge(batches):
        runs: dict[str, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                runs.setdefault(row[-1], []).append(row)
        for piece in runs.values():  # a run's rows may come in several blocks, each of them sorted
            piece[:] = heapq.merge(*_ascending(piece), key=_order)
        out = []
        for row in LoserTree(runs.values()):
            out.append(row)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], _NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], _NAMES)

    return index.repartitionByRange(partitions, "url_key", "time", F.col("id").asc_nulls_last(), "run", "offset").mapInArrow(merge, _INDEX)


def _ascending(rows: list) -> list[list]:
    """``rows`` cut wherever the order falls."""
    cuts = [0, *(i for i in range(1, len(rows)) if _order(rows[i]) < _order(rows[i - 1])), len(rows)]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:])]


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and merges their runs: one row per page, in capture order."""
    spark = df.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(df, path, id_col, url_col, html_col, min_bytes)
    runs = saved(read_warc(spark, path), "runs")
    return merge_runs(runs).select(F.col("id").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "url_key", "time", "offset", "length", F.col("run").alias("archive"))
