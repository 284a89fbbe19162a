"""WARC archives: writing records, and reading them back by boundary-chain verification.

Archives are written and read by Spark's text source, so they are split like any other file and may lie in any store.
They are cut where a record may begin: at the separator that ends every record followed by the magic. A task sees the
segments of its split in order. A segment that parses as a header is a candidate, and its content length names its
successor. Magic inside a payload makes candidates too, but no chain of successors from the file's start leads to them: within a split each
candidate is followed to where its chain leaves the split, and over splits the chains are joined by pointer jumping.
Only records that the start of the file reaches are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, pick, read_table, shared_dir, stored

SEP = "\r\n\r\n"
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Most rows of the table of splits that is broadcast: some 200 bytes each.
ENTRIES = 50_000
MAGIC = "WARC/1."
#: No beginning of it is also an ending, so the cuts do not depend on where a split begins.
CUT = SEP + MAGIC
_VERSION = re.compile(rb"[01]\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,15})[ \t]*(?:\r\n|$)", re.I)


# ---- writing


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(record): a record for each row, without its closing separator.

    Of equal payloads of REVISIT_BYTES or more, the row with the largest key is a response and the others revisit it
    (rows with that same key are all responses); smaller payloads are all responses. A null html is an empty payload;
    a null url is left out; a null key is written as `none`.
    """
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    raw = F.encode(body, "UTF-8")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{url}`").alias("u"), body.alias("b"), F.sha1(raw).alias("d"), F.octet_length(raw).alias("n"))
    signs = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.sha1(raw).alias("d"), F.octet_length(raw).alias("n"))
    # one row for each payload that several rows have: counted before the shuffle, and small beside the pages
    first = signs.where(F.col("n") >= REVISIT_BYTES).groupBy("d").agg(F.max("k").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d", "first")
    rows = rows.join(stored(first, "warc-first"), "d", "left")
    again = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(SEP))
    content = F.when(again, http).otherwise(F.concat(http, F.col("b")))
    link = F.regexp_replace(F.col("u"), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        ident(F.col("k")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), link), F.lit("")),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), ident(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("d"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit(SEP),
    )
    return rows.select(F.concat(head, content).alias("record"))


def write_warc(records: DataFrame, path: str) -> str:
    records.select("record").write.option("lineSep", SEP).text(path)
    return path


# ---- boundary chains


def _segments(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.option("lineSep", CUT).text(path)
    return got.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def candidate(head: bytes, first: bool) -> int | None:
    """Bytes from the magic to the next record if the segment's beginning is a record's header. The first segment of a
    file still has its magic."""
    lead = 0
    if first and head.startswith(MAGIC.encode()):
        lead = len(MAGIC)
    if not _VERSION.match(head, lead):
        return None
    n = _LENGTH.search(head, lead)
    return len(MAGIC) + len(head) - lead + 4 + int(n.group(1)) + 4 if n else None


def candidate_chains(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """For each split: (file, block, length) and, for each candidate in it, (file, block, at, out): its place and where
    the chain from it leaves the split, both relative to the split's first segment."""
    seg = _segments(spark, path)
    end = F.expr("position(X'0D0A0D0A', value)")
    head = F.when(end > 0, F.expr("substring(value, 1, position(X'0D0A0D0A', value) - 1)")).otherwise(F.col("value"))
    may = F.col("value").startswith(F.lit(b"0\r\n")) | F.col("value").startswith(F.lit(b"1\r\n")) | F.col("value").startswith(F.lit(MAGIC.encode()))
    light = seg.select("file", "block", F.octet_length("value").cast("long").alias("n"), F.when(may, head).alias("head"))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, found = None, 0, {}

        def flush():
            out = {}
            for s in sorted(found, reverse=True):
                out[s] = out.get(found[s], found[s])
            starts = sorted(found)
            n = len(starts) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * n), pa.array([now[1]] * n, pa.int64()), pa.array([None, *starts], pa.int64()), pa.array([at, *(out[s] for s in starts)], pa.int64())],
                names=["file", "block", "at", "out"],
            )

        for batch in it:
            for file, block, n, head in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (file, block):
                    if now is not None:
                        yield flush()
                    now, at, found = (file, block), 0, {}
                first = block == 0 and at == 0
                if head is not None and (c := candidate(head, first)):
                    begin = at if first else at - len(MAGIC)
                    found[begin] = begin + c
                at += n + len(CUT)
        if now is not None:
            yield flush()

    rows = stored(light.mapInArrow(scan, "file string, block bigint, at bigint, out bigint"), "warc-chains")
    return rows.where("at is null").select("file", "block", F.col("out").alias("length")), rows.where("at is not null")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, begin, entry): for each split the place of its first segment in the file and of the first record
    in it that the file's start reaches (null: none)."""
    lengths, chains = candidate_chains(spark, path)
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    begins = stored(lengths.withColumn("begin", F.coalesce(F.sum("length").over(w), F.lit(0))), "warc-begins")
    nodes = chains.join(begins, ["file", "block"]).select("file", "block", (F.col("begin") + F.col("at")).alias("node"), (F.col("begin") + F.col("out")).alias("next"))
    targets = nodes.select("file", F.col("next").alias("node")).distinct()
    start = F.col("node") == 0
    jump = nodes.join(targets.withColumn("t", F.lit(True)), ["file", "node"], "left").where(F.col("t") | start).select("file", "node", "next")
    jump = stored(jump, "warc-jump")
    reach = stored(jump.where(start).select("file", "node"), "warc-reach")
    longest = begins.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, math.ceil(math.log2(longest + 1)))):
        ahead = reach.join(jump, ["file", "node"]).select("file", F.col("next").alias("node"))
        reach = stored(reach.union(ahead).distinct(), "warc-reach")
        onward = jump.select("file", F.col("node").alias("next"), F.col("next").alias("after"))
        jump = stored(jump.join(onward, ["file", "next"]).select("file", "node", F.col("after").alias("next")), "warc-jump")
    here = nodes.join(reach, ["file", "node"]).groupBy("file", "block").agg(F.min("node").alias("entry"))
    return begins.join(here, ["file", "block"], "left").select("file", "block", "begin", "entry")


def _record_parts(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, at, raw, whole): the bytes after the magic of each record that its file's start reaches; whole, or
    in one part for each split it crosses (offset null: the part of a record that began in a split before).

    Each split's segments are joined with the place of its first record. The table of these has a row for each split;
    up to ENTRIES rows it is broadcast, beyond that both sides are shuffled by split and put in order again.
    """
    lead, cut = len(MAGIC), CUT.encode()

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, size = None, [], 0

        def flush():
            c = list(zip(*rows))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["file", "offset", "at", "raw", "whole"])

        record = to = pos = at = None
        parts: list[bytes] = []
        is_open = False

        def close():
            """to: where the open record ends."""
            raw = b"".join(parts)
            whole = record is not None and len(raw) + lead + 4 >= to - record
            rows.append((now[0], record, at, raw[: to - record - lead - 4] if whole else raw, whole))

        for batch in it:
            for file, block, value, begin, entry in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (file, block):
                    if is_open:
                        close()
                    now = (file, block)
                    pos = begin
                    # before the entry stands the rest of a record that began in a split before
                    record, parts, at, to, is_open = None, [], pos, -1 if entry is None else entry, block > 0
                first = block == 0 and pos == 0
                here = pos if first else pos - lead
                c = None
                if here == to:
                    end = value.find(b"\r\n\r\n")
                    c = candidate(value if end < 0 else value[:end], first)
                    if is_open and parts or record is not None:
                        close()
                    is_open, parts = c is not None, []
                    if c:
                        record, at, to = here, pos, here + c
                        parts.append(value[lead:] if first else value)
                    else:
                        record, to = None, -1
                elif is_open:
                    parts += [cut, value]
                pos += len(value) + len(cut)
                size += len(value)
                if rows and size > 4 << 20:
                    yield flush()
                    rows, size = [], 0
        if is_open and parts:
            close()
        if rows:
            yield flush()

    first_records = stored(entries(spark, path), "warc-entries")
    return arrow_rows(_with_entries(_segments(spark, path), first_records)).mapInArrow(read, "file string, offset bigint, at bigint, raw binary, whole boolean")


def _with_entries(segments: DataFrame, first_records: DataFrame, most: int = ENTRIES) -> DataFrame:
    """(file, block, value, begin, entry), the segments of each split in their order."""
    names = ["file", "block", "value", "begin", "entry"]
    if first_records.count() <= most:
        return segments.join(F.broadcast(first_records), ["file", "block"]).select(*names)
    there = segments.withColumn("_i", F.monotonically_increasing_id())
    return there.join(first_records.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "_i").select(*names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, header, content) of every record that the start of its file reaches; the header is what follows
    the magic.

    Most records lie in one split and are put together there. The parts of one that crosses splits are gathered by
    record, so memory follows the longest record. A chain that meets no candidate ends its file: later records can't
    be told from payload.
    """
    got = _record_parts(spark, path)
    parts = stored(got.where("not whole"), "warc-parts")
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # at most two parts a split
    named = parts.withColumn("offset", F.max("offset").over(w)).where("offset is not null")
    joined = named.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("parts"))
    joined = joined.select("file", "offset", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["raw"])).alias("raw"))
    raw = got.where("whole").select("file", "offset", "raw").unionByName(joined)
    out = raw.select("file", "offset", F.expr("substring(raw, 1, position(X'0D0A0D0A', raw) - 1)").alias("header"), F.expr("substring(raw, position(X'0D0A0D0A', raw) + 4)").alias("content"))
    want = F.regexp_extract(F.col("header").cast("string"), r"(?i)\r\ncontent-length:[ \t]*(\d+)", 1)
    out = out.withColumn("want", F.when(want != "", want.cast("long"))).where(F.octet_length("content") >= F.col("want"))
    return out.select("file", "offset", "header", F.expr("substring(content, 1, int(want))").alias("content"))


def field(name: str):
    """A header field's value, or null."""
    got = F.regexp_extract(F.col("header").cast("string"), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(got != "", got)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = pick(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    path = write_warc(warc_records(pages), shared_dir(spark, "warc"))
    ident = lambda n: F.regexp_extract(field(n), r"<urn:page:(-?\d+)>", 1)
    number = lambda n: F.when(ident(n) != "", ident(n).cast("long"))
    # the payload follows the HTTP header; positions are those of bytes
    body = F.expr("substring(content, position(X'0D0A0D0A', content) + 4)")
    records = read_warc(spark, path).select(
        number("WARC-Record-ID").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), r"sha1:([0-9a-f]{40})", 1).alias("named"),
        F.octet_length(body).cast("long").alias("n"),
        F.sha1(body).alias("d"),
        F.regexp_extract(F.expr("substring(content, 1, 512)").cast("string"), r"(?i)^HTTP/[^\r]*(?:\r\n[^\r\n]+)*?\r\ncontent-length:[ \t]*(\d+)", 1).cast("long").alias("told"),
    )
    again = F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        F.when(again, F.col("told")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(again, F.col("named")).otherwise(F.col("d")).alias("payload_digest"),
        "record_type",
        F.when(again, F.col("refers_to")).alias("refers_to"),
    )
