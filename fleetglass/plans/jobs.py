"""Nightly jobs: history by local day, baselines, replay of a day, lender reports."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fence import trusted
from ..operators.folds import fold_tables
from ..schema import COOLDOWN_S, LATE, LOCAL_OFFSET_S, MOVING_KMH

#: Parts of one day and cell that may be written apart, so that no task sorts a fleet's day alone; small ones are joined.
EXPORT_BLOCKS = 64


def local_date(ts: Column) -> Column:
    """The local calendar day of epoch seconds."""
    return F.to_date(F.timestamp_seconds(ts + LOCAL_OFFSET_S))


def local_hour(ts: Column) -> Column:
    return F.floor(F.pmod(ts + LOCAL_OFFSET_S, F.lit(86_400.0)) / 3600).cast("int")


def day_bounds(day: str) -> tuple[Column, Column]:
    """Epoch seconds at which a local day begins and ends."""
    start = F.unix_seconds(F.lit(day).cast("timestamp")) - LOCAL_OFFSET_S
    return start, start + 86_400


def day_list(last: str, days: int) -> Column:
    """The local days up to ``last``, oldest first."""
    end = F.lit(last).cast("date")
    return F.sequence(F.date_sub(end, days - 1), end)


def export_rows(telemetry: DataFrame) -> DataFrame:
    """Telemetry as it is stored for history: with its local date and two-character cell."""
    return telemetry.withColumn("date", F.date_format(local_date(F.col("device_ts")), "yyyy-MM-dd")).withColumn("cell", F.substring("geohash", 1, 2))


def export(telemetry: DataFrame, root: str) -> None:
    """Writes the days' partitions anew; other days stay. Vehicles of a partition are dealt over several tasks and files."""
    block = F.pmod(F.xxhash64("vehicle_id"), F.lit(EXPORT_BLOCKS))
    rows = export_rows(telemetry).repartition("date", "cell", block).sortWithinPartitions("date", "cell", "vehicle_id", "device_ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "cell").parquet(root)


def exported_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("date").agg(F.count("*").alias("n"))


def missing_days(wanted: DataFrame, history: DataFrame, today: str) -> DataFrame:
    """Wanted days (``date``) without a partition, and today in any case."""
    there = history.select("date").distinct().where(F.col("date") < today)
    return wanted.join(there, "date", "left_anti")


def baselines(telemetry: DataFrame) -> DataFrame:
    """Each vehicle's usual night and day cells, driving hours [active_from, active_to), mean and deviation of speed.

    Of cells seen equally often the first in the alphabet counts.
    """
    h, parked, drives = F.col("h"), F.col("speed_kmh") < MOVING_KMH, (F.col("speed_kmh") >= MOVING_KMH) & trusted()
    hours = telemetry.withColumn("h", local_hour(F.col("device_ts")))
    share = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY CASE WHEN speed_kmh >= {MOVING_KMH} AND NOT array_contains(flags, 'suspect_gps') THEN h END)")
    out = hours.groupBy("vehicle_id").agg(
        F.mode(F.when(parked & ((h < 6) | (h >= 22)), F.col("geohash")), True).alias("home_cell"),
        F.mode(F.when(parked & h.between(10, 16), F.col("geohash")), True).alias("work_cell"),
        share(0.05).cast("int").alias("active_from"), (share(0.95).cast("int") + 1).alias("active_to"),
        F.avg(F.when(drives, F.col("speed_kmh"))).alias("avg_speed"), F.stddev_samp(F.when(drives, F.col("speed_kmh"))).alias("_std"), F.count_if(drives).alias("_n"),
    )
    return out.withColumn("std_speed", F.when(F.col("_n") > 0, F.coalesce("_std", F.lit(0.0)))).drop("_std", "_n")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows with those of the same key replaced by new ones, and the rest of the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replay_rows(history: DataFrame, day: str, before: int = 0) -> DataFrame:
    """A day's telemetry for replay: late rows included, without their mark.

    ``before`` adds the days that lead to it, so that windows, trips, runs outside a fence and fading signals stand when the
    day begins; signals fade within one day.
    """
    days = F.transform(day_list(day, before + 1), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return history.where(F.array_contains(days, F.col("date"))).withColumn("flags", F.filter("flags", lambda f: (f != LATE) & (f != "")))


def of_day(decided: DataFrame, day: str) -> DataFrame:
    """What fired within a local day."""
    start, end = day_bounds(day)
    return decided.where((F.col("fired_ts") >= start) & (F.col("fired_ts") < end))


class _Apart:
    """Takes, key by key and in the order of rows, those whose time is far enough from the times taken before.

    Times taken are kept sorted, so that the neighbours on both sides tell.
    """

    def __init__(self) -> None:
        self.key, self.times = None, []

    def take(self, table: pa.Table) -> pa.Table:
        keys, good = zip(table["vehicle_id"].to_pylist(), table["code"].to_pylist(), strict=True), []
        for key, ts in zip(keys, table["ts"].to_pylist(), strict=True):
            if key != self.key:
                self.key, self.times = key, []
            at = bisect.bisect(self.times, ts)
            far = ts - self.times[at - 1] >= COOLDOWN_S if at else True
            far = far and (self.times[at] - ts >= COOLDOWN_S if at < len(self.times) else True)
            if far:
                self.times.insert(at, ts)
            good.append(far)
        return table.filter(pa.array(good, pa.bool_()))

    def end(self) -> None:
        return None


def missed_alerts(replayed: DataFrame, stored: DataFrame) -> DataFrame:
    """Replayed alerts (vehicle_id, code, ts, score, in order of ``fired_ts``) away from all stored (vehicle_id, code, ts).

    The nearest stored alerts before and after come from windows over both; what is near neither is thinned by itself.
    """
    names = ["vehicle_id", "code", "ts", "lat", "lon", "score", "fired_ts"]
    new = replayed.where("write_alert").select(*names, F.lit(None).cast("double").alias("_stored"))
    old = stored.select("vehicle_id", "code", "ts", *[F.lit(0.0).alias(c) for c in names[3:]], F.col("ts").alias("_stored"))
    order = Window.partitionBy("vehicle_id", "code").orderBy("ts")
    last = F.last("_stored", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    first = F.first("_stored", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    both = new.unionByName(old).withColumn("_last", last).withColumn("_first", first).where("_stored IS NULL")
    far = (F.coalesce(F.col("ts") - F.col("_last"), F.lit(COOLDOWN_S)) >= COOLDOWN_S) & (F.coalesce(F.col("_first") - F.col("ts"), F.lit(COOLDOWN_S)) >= COOLDOWN_S)
    return fold_tables(both.where(far).select(*names), ["vehicle_id", "code"], ["fired_ts", "ts"], _Apart, "vehicle_id string, code string, ts double, lat double, lon double, score double")


def raised_scores(board: DataFrame, missed: DataFrame) -> DataFrame:
    """The leaderboard (vehicle_id, score) with each score raised to the missed alerts' if that is greater."""
    peak = missed.groupBy("vehicle_id").agg(F.max("score").alias("_new"))
    return board.join(peak, "vehicle_id", "full").select("vehicle_id", F.greatest("score", "_new").alias("score"))


def lender_report(lenders: DataFrame, loans: DataFrame, alerts: DataFrame, cases: DataFrame, start: float, end: float, top: int = 25) -> DataFrame:
    """One row for each lender (lender_id, name) with the figures of a local day [start, end) in epoch seconds.

    ``alerts``: vehicle_id, code, created_ts, risk_score. ``cases``: loan_id, status, opened_ts.
    """
    open_loans = loans.where("status <> 'closed'").groupBy("lender_id").agg(F.count("*").alias("vehicles"))
    today = alerts.where((F.col("created_ts") >= start) & (F.col("created_ts") < end)).join(loans.select("vehicle_id", "lender_id", "days_past_due"), "vehicle_id")
    by_code = today.groupBy("lender_id", "code").agg(F.count("*").alias("n"))
    by_code = by_code.groupBy("lender_id").agg(F.sum("n").alias("alerts"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "code", "n"))), lambda x: F.struct(x["code"].alias("code"), x["n"].alias("n"))).alias("alerts_by_signal"))
    peaks = today.groupBy("lender_id", "vehicle_id").agg(F.max("risk_score").cast("double").alias("peak_score"), F.max("days_past_due").alias("days_past_due"))
    ranked = peaks.withColumn("_r", F.row_number().over(Window.partitionBy("lender_id").orderBy(F.desc("peak_score"), "vehicle_id")))
    at_risk = ranked.groupBy("lender_id").agg(F.count("*").alias("vehicles_with_alerts"), F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "vehicle_id", "peak_score", "days_past_due")))).alias("at_risk"))
    month = end - 30 * 86_400
    outcome = cases.join(loans.select("loan_id", "lender_id"), "loan_id").groupBy("lender_id").agg(
        F.count_if((F.col("opened_ts") >= start) & (F.col("opened_ts") < end)).alias("cases_opened"),
        *[F.count_if((F.col("opened_ts") >= month) & (F.col("status") == s)).alias(f"cases_{s}_30d") for s in ("open", "in_progress", "recovered", "closed")],
    )
    out = lenders
    for part in (open_loans, by_code, at_risk, outcome):
        out = out.join(part, "lender_id", "left")
    counts = ["vehicles", "alerts", "vehicles_with_alerts", "cases_opened", *[f"cases_{s}_30d" for s in ("open", "in_progress", "recovered", "closed")]]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    done = F.col("cases_recovered_30d") + F.col("cases_closed_30d")
    out = out.withColumn("recovery_rate_30d", F.when(done > 0, F.bround(F.col("cases_recovered_30d") / done, 3)).otherwise(F.lit(0.0)))
    empty = out.withColumn("alerts_by_signal", F.coalesce("alerts_by_signal", F.array().cast("array<struct<code:string,n:bigint>>")))
    return empty.withColumn("at_risk", F.transform(F.coalesce("at_risk", F.array()), lambda x: x.dropFields("_r")))


def write_reports(reports: DataFrame, date: str, root: str) -> None:
    """One JSON document for each lender and day."""
    reports.withColumn("date", F.lit(date)).repartition("lender_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lender_id", "date").json(root)


def read_reports(spark, root: str) -> DataFrame:
    """The written reports with their lender_id and date."""
    return spark.read.option("basePath", root).json(root).withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn("lender_id", F.col("lender_id").cast("long"))


def report_of(reports: DataFrame, date: str | None = None) -> DataFrame:
    """Each lender's report of a day, or the newest one if no day is given."""
    return reports.where(F.col("date") == date) if date else latest_report(reports)


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest report of each lender from rows with lender_id, date and other columns."""
    rest = [c for c in reports.columns if c != "lender_id"]
    return reports.groupBy("lender_id").agg(F.max_by(F.struct(*rest), "date").alias("_d")).select("lender_id", "_d.*")


def retained(history: DataFrame, today: str, days: int = 30) -> DataFrame:
    """History whose local day is at most ``days`` old."""
    return history.where(F.col("date") >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))
