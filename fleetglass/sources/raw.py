"""Where payloads and events come from, and where results go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, LATE, RAW


def split_bodies(bodies: DataFrame) -> DataFrame:
    """A row for each non-empty line of ``body``, with the other columns."""
    rest = [c for c in bodies.columns if c != "body"]
    return bodies.select(*rest, F.explode(F.split("body", "\n")).alias("line")).where(F.length("line") > 0)


def vehicle_key(line: Column) -> Column:
    """The first vehicle id in a payload, null if there is none."""
    return F.nullif(F.regexp_extract(line, r"VH-\d{6}", 0), F.lit(""))


def raw_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload files: payload, ingest_ts and offset."""
    return spark.read.schema(RAW).parquet(path)


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of files; a broker's topic has these columns too (its timestamp is ingest_ts)."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def from_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """Canonical events from their JSON."""
    return rows.select(F.from_json(column, EVENT).alias("e")).select("e.*")


def to_json(events: DataFrame) -> DataFrame:
    """Canonical events as JSON with the vehicle as key."""
    return events.select(F.col("vehicle_id").alias("key"), F.to_json(F.struct(*[x.split(" ")[0] for x in EVENT.split(", ")])).alias("value"))


def store_feed(normalized: DataFrame, late: DataFrame) -> DataFrame:
    """Both topics as one feed for the store; late rows are marked in their flags."""
    return normalized.unionByName(late.withColumn("flags", F.concat("flags", F.array(F.lit(LATE)))))


def storage_rows(events: DataFrame) -> DataFrame:
    """The stored form: times as text in UTC microseconds, flags in braces."""
    stamp = lambda c: F.date_format(F.timestamp_micros(F.bround(F.col(c) * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return events.withColumn("device_ts", stamp("device_ts")).withColumn("ingest_ts", stamp("ingest_ts")).withColumn("flags", F.concat(F.lit("{"), F.array_join("flags", ","), F.lit("}")))


def read_days(spark: SparkSession, root: str, days: list[str]) -> DataFrame:
    """History of the given local days; other partitions are not listed."""
    return spark.read.parquet(root).where(F.col("date").cast("string").isin(*days))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and declared types."""
    return spark.read.schema(schema).option("header", True).csv(path)


def open_cases(cases: DataFrame, loans: DataFrame) -> DataFrame:
    """Vehicles whose loan has a case that is open or in progress."""
    return cases.where(F.col("status").isin("open", "in_progress")).select("loan_id").join(loans, "loan_id").select("vehicle_id").distinct()


def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch that the store does not have, once for each (vehicle_id, device_ts, event_id)."""
    key = ["vehicle_id", "device_ts", "event_id"]
    return batch.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
