"""Exact deduplication of lines across documents, with DataFrame functions alone.

Each text is split once; its lines' keys, hashed to 128 bits, go to a table of (hash, document, position). A hash with more
than a ten-thousandth of all rows is heavy. There can be ten thousand of these at most, so their verdicts are broadcast and
their rows need no shuffle by hash. The other rows are range-partitioned by hash with document and position as secondary
sort, latest document first; the first occurrence in that stream stays and the ones behind it go if enough documents hold
the hash. What returns is no text but one keep bitmap for each document that loses a line: a map from a block of 64 lines
to the bits of those that stay; blocks that are not in it stay whole.

Null or empty texts are one empty line. Rows without a doc_id take no part and come back unchanged. Rows that repeat a
doc_id count as one document in the count of holders; each keeps or loses its own lines. An empty table gives no rows.
Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

HEAVY = 10_000
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII space at its ends, A-Z in lower case."""
    return F.translate(F.regexp_replace(line, _EDGE, ""), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def held_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line with a long enough key: h1, h2 (the key's hash), doc_id, version (the text's hash), at."""
    keyed = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select(
        "doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("at", "key")
    )
    return keyed.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key", F.length("key")).alias("h2"), "doc_id", "version", "at")


def lost_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """Of a table of held lines those (doc_id, version, at) that a later document holds too, if enough documents do."""
    counts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    heavy = written(counts.where(F.col("n") > rows.count() // HEAVY).select("h1", "h2"), "heavy")
    hot = rows.join(F.broadcast(heavy), ["h1", "h2"])
    holders = hot.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("holders"), F.max("doc_id").alias("last"))
    verdicts = holders.where(F.col("holders") >= min_docs).select("h1", "h2", "last")
    lost_hot = rows.join(F.broadcast(verdicts), ["h1", "h2"]).where(F.col("doc_id") < F.col("last"))
    rest = rows.join(F.broadcast(heavy), ["h1", "h2"], "left_anti")
    stream = rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "at")
    along = Window.partitionBy("h1", "h2").orderBy(F.desc("doc_id"), "at")
    seen = stream.withColumn("first", F.first("doc_id").over(along)).withColumn("nth", F.dense_rank().over(along))
    seen = seen.withColumn("holders", F.last("nth").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    lost = seen.where((F.col("doc_id") < F.col("first")) & (F.col("holders") >= min_docs))
    return lost.select("doc_id", "version", "at").unionByName(lost_hot.select("doc_id", "version", "at"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """For each document (doc_id, version) that loses lines, ``bits``: block of 64 lines -> mask of the lines that stay."""
    lost = lost_lines(written(held_lines(docs, min_chars), "lines"), min_docs)
    gone = F.bit_or(F.expr("shiftleft(1L, at & 63)"))
    blocks = lost.groupBy("doc_id", "version", F.shiftright("at", 6).alias("block")).agg(F.bitwise_not(gone).alias("mask"))
    return blocks.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("bits"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with ``text`` replaced by what stays, n_lines before dropping and n_dropped."""
    own, version, map_ = fresh(docs, "own", "version", "bits")
    bits = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(own), F.col("version").alias(version), F.col("bits").alias(map_))
    joined = docs.join(bits, (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(version)), "left")

    def stays(_: Column, at: Column) -> Column:
        mask = F.element_at(map_, F.shiftright(at, 6))
        return F.coalesce(F.getbit(mask, at.bitwiseAND(63)) == 1, F.lit(True))

    lines = _lines(F.col("text"))
    kept = F.when(F.col(map_).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    dropped = F.coalesce(F.aggregate(F.map_values(map_), F.lit(0), lambda n, m: n + 64 - F.bit_count(m)), F.lit(0))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"),
    )


def line_digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays of each document."""
    out = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
