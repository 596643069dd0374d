"""WARC archives: writing, reading back, and the external merge of their indexes.

Writing. One record per capture; of captures with equal payloads of at least
REVISIT_BYTES bytes the one with the largest page_id is the response and the others
are revisits of it. A record is text with CRLF lines and ends with two CRLF. Each record is a gzip member of
its own, so that a record can be read from its place in the archive alone. Spark's text writer makes the files, committed like any
other output to whatever file system the folder is on: a member's last byte is the highest byte of its
record's size, which is the same for all records of a file, and is written as the line separator.

Reading. A task takes whole archives, unpacks them member by member and notes where each record's member begins and how long it is;
archives without compression are cut by the records' Content-Length. Payload size and SHA-1 of a response are computed again from
the payload; those of a revisit come from its header.

Index. The records of an archive, sorted by (url key, time, page_id), are a run. Spark's range
exchange deals the runs out over ranges of the whole sort key, so that a URL with a
third of all captures is split too; what one range gets of every run meets in one task, which
merges its k runs (a new one begins wherever the order falls back) with a loser tree.
Ranges in order are the global capture history.

Defined cases: a null html is an empty payload; a null url is written empty, and line
breaks in a URL are percent-encoded; a null page_id is written empty, reads back as
null and never becomes a response that others refer to unless all are null; rows
that repeat a page_id have a record each, under one record id; equal keys stand in the order of
archive and offset; very long payloads are whole, in archives of few records; an empty table
makes an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import arrow_once, new_path, save, sized

REVISIT_BYTES = 1000
#: An archive holds so many records of up to SMALL_BYTES, a quarter as many of up to four times that, and so on: at
#: most 512 MB before compression, or one longer record.
RECORDS_PER_FILE, SMALL_BYTES = 8192, 64 << 10
#: Captures of one range of the merged index.
RANGE_ROWS = 100_000
END = "\r\n\r\n"
ID = "urn:capture:"
INDEX = "url_key string, captured string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, archive string, offset bigint, length bigint"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(captures: DataFrame) -> DataFrame:
    """record: the text of a WARC record for each (page_id, url, html, captured) row; and its size_class."""
    html = F.coalesce("html", F.lit(""))
    c = captures.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"), "captured", size_class().alias("size_class"), F.octet_length(html).alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    # A payload that recurs is one row per task after the map-side sum, however many captures have it.
    repeats = c.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1")
    repeats = sized(save(repeats.select("digest", F.col("bytes").alias("__bytes"), "of"), "repeats"))
    c = c.join(repeats, ["digest"], "left").withColumn("revisit", F.coalesce((F.col("bytes") == F.col("__bytes")) & ~F.col("page_id").eqNullSafe(F.col("of")), F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    name = lambda of: F.concat(F.lit(f"<{ID}"), F.coalesce(of.cast("string"), F.lit("")), F.lit(">"))
    head = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Date: "), F.coalesce("captured", F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("of")), F.lit(f"\r\nWARC-Profile: {_PROFILE}"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return c.select(F.concat(F.concat_ws("\r\n", *head), F.lit(END), block).alias("record"), F.col("size_class"))


def size_class() -> Column:
    """How often the size of payload and URL is to be quartered until it is small."""
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit("")))
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(size, F.lit(1)) / SMALL_BYTES))).cast("int")


#: Records of smaller classes have less than 2**24 bytes, so that the last byte of their members is 0.
LARGE_CLASS = 4


def _member(record: pa.Array) -> pa.Array:
    out = []
    for r in record:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append((z.compress(r.as_buffer()) + z.flush())[:-1])
    return pa.array(out, pa.binary())


def write(captures: DataFrame, path: str, compression: str = "gzip") -> None:
    """The captures as archives: a gzip member for each record, or with compression none as they are."""
    sizes = captures.groupBy(size_class().alias("c")).agg(F.count("*").alias("n")).collect()  # 16 classes at most
    made = records(captures)
    for c in sorted(r.c for r in sizes) or [0]:
        of_class = made.where(F.col("size_class") == c).select("record")
        files = lambda df, end: df.write.mode("append").option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> 2 * c)).text(path)  # noqa: B023, E731
        if compression == "none":
            files(of_class, END)
            continue
        whole = of_class.select(F.concat("record", F.lit(END)).cast("binary").alias("record")).withColumn("last", F.shiftright(F.octet_length("record"), 24).bitwiseAND(255))
        for last in [0] if c < LARGE_CLASS else sorted(r.last for r in whole.select("last").distinct().collect()):  # 256 at most
            files(whole.where(F.col("last") == last).select(arrow_once(_member, "binary")("record").cast("string").alias("value")), chr(last))


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records of one archive; offset and length are places in the file."""
    view, at = memoryview(content), 0
    packed = content[:2] == b"\x1f\x8b"
    while at < len(view):
        if packed:
            length, record = member(view, at)
            head, start = _head(record, 0)
            block = record[start : start + int(head["Content-Length"])]
        else:
            head, start = _head(content, at)
            length = start + int(head["Content-Length"]) + 4 - at
            block = content[start : at + length - 4]
        if len(block) < int(head["Content-Length"]):
            raise ValueError("the archive ends within a record")
        yield at, length, head, bytes(block)
        at += length


def member(view: memoryview, at: int) -> tuple[int, bytes]:
    """(length, record) of the gzip member that begins at a place of an archive."""
    unzip, out, fed = zlib.decompressobj(31), [], at
    while not unzip.eof:
        if fed >= len(view):
            raise ValueError("the archive ends within a record")
        piece = view[fed : fed + (1 << 16)]
        fed += len(piece)
        out.append(unzip.decompress(piece))
    return fed - len(unzip.unused_data) - at, b"".join(out)


def _head(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    """(headers, where the block begins) of the record at a place."""
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("the archive ends within a record")
    lines = bytes(raw[at:end]).decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines), end + 4


def url_key(url: str) -> str:
    """The host's labels reversed, then path and query; in lower case, without scheme, port, www and fragment."""
    import re

    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#:]*)[^/?#]*([^#]*)", url.lower(), re.DOTALL)
    if not m:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", m[1])
    return ",".join(reversed(host.split("."))) + ")" + (m[2].rstrip("/") or "/")


def read(spark, path: str) -> DataFrame:
    """The index of all archives under path, one row per record, each archive's rows sorted as a run."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda name: int(x) if (x := name.rpartition(ID)[2].rstrip(">")) else None
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                run = []
                for offset, length, head, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if head["WARC-Type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        size, digest = int(http.rpartition(b"Content-Length: ")[2]), head["WARC-Payload-Digest"].partition(":")[2]
                    run.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], size, digest, number(head.get("WARC-Refers-To", ""))) + (archive.rpartition("/")[2], offset, length))
                run.sort(key=sort_key)
                yield batch_of(run)

    files = spark.read.format("binaryFile").load(path).where("path NOT LIKE '%/\\_%'").select("path", "content")
    return files.mapInArrow(of, INDEX)


_ARROW = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "bigint" else pa.string()) for f in INDEX.split(", ")])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def sort_key(row: tuple) -> tuple:
    """(url key, time, page_id), nulls last; then where the record stands."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Rows of sorted runs in order. Each inner node keeps the loser of its match, so a row costs log2(k) comparisons."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    head = [(0, sort_key(r[0])) if r else (1,) for r in runs]  # (1,) loses against every row
    loser = [-1] * k  # node 0 holds the winner
    for leaf in range(k):  # play each leaf up until it meets an empty node
        player, node = leaf, (leaf + k) // 2
        while node and loser[node] >= 0:
            if head[loser[node]] < head[player]:
                player, loser[node] = loser[node], player
            node //= 2
        loser[node] = player
    while head[winner := loser[0]] != (1,):
        yield runs[winner][at[winner]]
        at[winner] += 1
        head[winner] = (0, sort_key(runs[winner][at[winner]])) if at[winner] < len(runs[winner]) else (1,)
        player, node = winner, (winner + k) // 2
        while node:
            if head[loser[node]] < head[player]:
                player, loser[node] = loser[node], player
            node //= 2
        loser[0] = player


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """index with `position`, its place in the global order of (url key, time, page_id)."""
    spark = index.sparkSession
    ranges = max(1, -(-index.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple]] = []
        last = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None or sort_key(row) < last:
                    runs.append([])
                runs[-1].append(row)
                last = sort_key(row)
        rows, part, done = loser_tree(runs), TaskContext.get().partitionId(), 0
        while out := list(islice(rows, 10_000)):
            yield pa.record_batch([*batch_of(out).columns, pa.array([part] * len(out), pa.int32()), pa.array(range(done, done + len(out)), pa.int64())], names=[*_ARROW.names, "part", "local"])
            done += len(out)

    order = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_last(), F.col("archive"), F.col("offset")]
    merged = save(index.select(*_ARROW.names).repartitionByRange(ranges, *order).mapInArrow(merge, f"{INDEX}, part int, local bigint"), "merged")
    # the sizes of the ranges, a row each, make the places where they begin
    sizes = sorted((r.part, r.n) for r in merged.groupBy("part").agg(F.count("*").alias("n")).collect())
    begins, total = [], 0
    for part, size in sizes:
        begins.append((part, total))
        total += size
    at = spark.createDataFrame(begins, "part int, begin bigint")
    return merged.join(F.broadcast(at), "part").withColumn("position", F.col("begin") + F.col("local")).drop("part", "local", "begin")


def captured(page_id: Column) -> Column:
    """pages have no capture time: a second of 2024 that follows from the page_id."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(page_id, F.lit(0)) * 104729, F.lit(31622400))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def histories(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read them back and merge their indexes."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages.select("page_id", "url", "html", captured(F.col("page_id")).alias("captured")), path)
    return merge_index(save(read(spark, path), "index"))


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, position in the global history."""
    return histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


REPORT_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, 1704067200 + (page_id * 104729) % 31622400 AS second FROM pages),
q AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS resp,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www[0-9]*[.]', '') AS host,
    rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)', 1), '/') AS rest FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> resp THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> resp THEN resp END AS refers_to, row_number() OVER (ORDER BY url_key, second, page_id) - 1 AS position FROM k
"""
