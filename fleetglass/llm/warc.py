"""Web archives: writing WARC files with revisit records, and reading them back with a verified chain of records.

A page's record holds its html behind an HTTP head. Of pages with equal payloads the largest page_id is the response and
the others revisit it; null html is an empty payload. Files are written as text whose line separator is the end of a record.

On reading, tasks cut the files at every magic string, also at those inside payloads. Each piece is a candidate record and
names its successor's offset by its Content-Length. Pointer jumping from the start of each file keeps the candidates that
the chain reaches; the other pieces are parts of the payload before them and are put back there.

Rows without page_id are records with an id of no page: they take no part in the choice of the response, and never revisit. Rows
that repeat the page_id and payload of a response are responses too. An empty table writes no record and gives no rows.
Other columns play no part.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: The alphabet of base 32 (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What a revisit of an equal payload names in WARC 1.1 (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 2000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FACTS = "record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string"
_PIECE = f"file string, block long, rel long, size long, next_rel long, complete boolean, {_FACTS}, piece binary"
FACTS = ("record_type", "page_id", "refers_to", "payload_bytes", "payload_digest")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32."""

    def letters(code: Column) -> Column:
        numbers = [F.conv(F.substring(code, at, 10), 16, 10).cast("long") for at in (1, 11, 21, 31)]
        return F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(n, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for n in numbers for s in range(35, -1, -5)])

    # bound by the lambda, the SHA-1 is taken once and not for each letter
    return F.transform(F.array(F.sha1(payload)), letters)[0]


def _revisits(pages: DataFrame) -> DataFrame:
    """page_id and digest of the pages that revisit, and the page with their payload that is kept; html itself is not shuffled."""
    facts = pages.where("page_id IS NOT NULL").select("page_id", _digest().alias("digest")).distinct()
    shared = facts.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("_n")).where("_n > 1")
    return facts.join(shared, "digest").where("page_id < last").select("page_id", "digest", "last")


def _digest() -> Column:
    return base32_sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def archive_records(pages: DataFrame) -> DataFrame:
    """page_id and the whole ``record`` of each page, without its end.

    Pages meet what is known of their payload by their id, so copies of one payload spread over all tasks.
    """
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _digest().alias("digest"))
    named = known.where("page_id IS NOT NULL").join(_revisits(pages), ["page_id", "digest"], "left")
    joined = named.unionByName(known.where("page_id IS NULL").withColumn("last", F.lit(None).cast("long")))
    revisit = F.col("last").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(~revisit, F.col("html")).otherwise(""))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    anonymous = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = F.concat(
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), anonymous)), line("WARC-Date", F.lit(now)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), line("WARC-Refers-To", F.when(revisit, urn(F.col("last")))), line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return joined.select("page_id", F.concat(F.lit(MAGIC), head, F.lit("\r\n"), block).alias("record"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Writes the pages as WARC files of at most ``records_per_file`` records."""
    archive_records(pages).select("record").write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def _parsed(piece: bytes) -> tuple[int | None, bytes | None, dict[bytes, bytes]]:
    """The length that the piece claims as a record, its payload if it is all there, and its head's fields."""
    head, sep, _ = piece.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n") if b": " in x) if sep else {}
    if not re.fullmatch(rb"\d{1,15}", fields.get(b"Content-Length", b"")) or b"WARC-Type" not in fields:
        return None, None, fields
    long = len(head) + 4 + int(fields[b"Content-Length"]) + 4
    if long != len(piece):
        return long, None, fields
    return long, piece[len(head) + 4 : -4].partition(b"\r\n\r\n")[2], fields


def _number(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _facts(piece: bytes) -> tuple:
    """next (from the piece's start), complete, record_type, page_id, refers_to, payload_bytes, payload_digest."""
    long, payload, fields = _parsed(piece)
    kind, size = fields.get(b"WARC-Type", b"").decode("utf-8", "replace"), None
    digest = fields.get(b"WARC-Payload-Digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    if payload is not None and kind != "revisit":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return long, payload is not None, kind, _number(fields.get(b"WARC-Record-ID")), _number(fields.get(b"WARC-Refers-To")), size, digest


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with offsets from the first piece of the file's block.

    Bytes go along only where another record may need them. In a file's first block the chain is known, so that is every
    piece off the chain or cut short; in later blocks it is every piece.
    """
    at: dict[tuple[str, int], int] = {}
    chain: dict[str, int | None] = {}
    for batch in batches:
        rows = []
        for file, block, value in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"].to_pylist(), strict=True):
            rel = at.get((file, block), 0)
            size = len(value) + len(MAGIC)
            at[file, block] = rel + size
            long, complete, *rest = _facts(value)
            following = None if long is None else rel + long + len(MAGIC)
            alone = complete and block == 0 and rel == chain.get(file, len(MAGIC))
            if block == 0 and rel == chain.get(file, len(MAGIC)):
                chain[file] = following
            rows.append((file, block, rel, size, following, complete, *rest, None if alone else value))
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)


_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("next_rel", pa.int64()), ("complete", pa.bool_()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("piece", pa.binary())])


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All pieces of the files under ``path`` with ``at``, their offset in the file, and ``next``, their successor's."""
    # the magic at a file's start makes an empty piece before it, so text that begins at rel has its magic at rel - 10
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = written(arrow_map(raw, _candidates, _PIECE), "pieces")
    totals = pieces.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = totals.alias("t").join(totals.alias("u"), (F.col("t.file") == F.col("u.file")) & (F.col("u.block") < F.col("t.block")), "left")
    bases = before.groupBy("t.file", "t.block").agg(F.coalesce(F.sum("u.total"), F.lit(0)).alias("base"))
    placed = pieces.join(bases, ["file", "block"])
    out = placed.withColumn("at", F.col("base") + F.col("rel") - len(MAGIC)).withColumn("next", F.col("base") + F.col("next_rel") - len(MAGIC))
    return out.where(F.col("at") >= 0).drop("block", "rel", "size", "next_rel", "base")


def reachable(chain: DataFrame) -> DataFrame:
    """file and at of the candidates (file, at, next) that a chain from offset 0 of their file reaches, by pointer jumping."""
    now = written(chain.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("reached")), "chain")
    known = now.where("reached").count()
    while True:
        ahead = now.select("file", F.col("at").alias("jump"), F.col("jump").alias("_further"))
        marks = now.where("reached").select("file", F.col("jump").alias("at"), F.lit(True).alias("_mark"))
        now = now.join(ahead, ["file", "jump"], "left").join(marks, ["file", "at"], "left")
        now = written(now.select("file", "at", F.col("_further").alias("jump"), (F.col("reached") | F.coalesce("_mark", F.lit(False))).alias("reached")), "chain")
        found = now.where("reached").count()
        if found == known:
            return now.where("reached").select("file", "at")
        known = found


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for parts in batch["parts"].to_pylist():
            _, complete, *rest = _facts(MAGIC.encode().join(parts))
            if not complete:
                raise ValueError("a reachable record is shorter or longer than it says")
            rows.append(dict(zip(FACTS, rest, strict=True)))
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([_SCHEMA.field(k) for k in FACTS]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_type, page_id, refers_to, payload_bytes and payload_digest of every record that a chain reaches."""
    pieces = candidates(spark, path)
    heads = reachable(pieces.where(F.col("next").isNotNull()).select("file", "at", "next"))
    marked = pieces.join(heads.withColumn("_head", F.lit(True)), ["file", "at"], "left")
    before = Window.partitionBy("file").orderBy("at")
    owner = F.last(F.when(F.col("_head"), F.struct(F.col("at").alias("from"), F.col("next").alias("to"), "complete")), ignorenulls=True).over(before)
    owned = marked.withColumn("_owner", owner).where(F.col("at") < F.col("_owner.to"))
    single = owned.where(F.col("_head") & F.col("complete")).select(*FACTS)
    # a false magic cuts a record, so its head is incomplete and its other parts lie before its successor
    parts = owned.where(~F.col("_owner.complete")).groupBy("file", "_owner.from").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    whole = arrow_map(parts.select(F.transform("parts", lambda x: x["piece"]).alias("parts")), _whole, _FACTS)
    return single.unionByName(whole)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    records = written(read_archives(spark, path), "records")
    responses = records.where(F.col("record_type") == "response")
    full = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where(F.col("record_type") == "revisit").drop("payload_bytes").join(full, ["refers_to", "payload_digest"], "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*out).unionByName(revisits.select(*out))
