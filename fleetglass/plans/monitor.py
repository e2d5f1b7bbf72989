"""Figures on the running system and its upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(counters: DataFrame) -> DataFrame:
    """Rates of cumulative counters (name, at, value) between samples, not below 0."""
    order = Window.partitionBy("name").orderBy("at")
    step = (F.col("value") - F.lag("value").over(order)) / (F.col("at") - F.lag("at").over(order))
    return counters.withColumn("_step", step).where("_step IS NOT NULL").withColumn("rate", F.greatest(F.lit(0.0), F.col("_step"))).drop("_step")


def latency_percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The 50th, 90th and 99th percentile by the exclusive method, to one decimal: place q * (n + 1), linear between."""
    order = Window.partitionBy(*keys).orderBy(value) if keys else Window.orderBy(value)
    frame = rows.where(F.col(value).isNotNull())
    ranked = frame.withColumn("_i", F.row_number().over(order)) if keys else _ranked(frame, value)
    total = ranked.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = ranked.join(total, list(keys)) if keys else ranked.join(F.broadcast(total))  # one row
    out = []
    for q in (50, 90, 99):
        place = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.lit(q) * (F.col("_n") + 1) / 100))
        share = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_i") - place))
        out.append(F.bround(F.sum(share * F.col(value)), 1).alias(f"p{q}"))
    return joined.groupBy(*keys).agg(*out)


def _ranked(frame: DataFrame, value: str) -> DataFrame:
    from ..operators.numbering import numbered

    return numbered(frame, value, name="_i")


def raw_summary(normalised: DataFrame) -> DataFrame:
    """Payloads by format: how many, unreadable, vehicles, moving rows, moving with ignition off."""
    e = F.col("event")
    moving = F.coalesce(e["speed_kmh"] >= 5, F.lit(False))
    return normalised.groupBy("format").agg(
        F.count("*").alias("payloads"), F.count_if(F.col("reason").isNotNull()).alias("unreadable"), F.count_distinct(e["vehicle_id"]).alias("vehicles"),
        F.count_if(moving).alias("moving"), F.count_if(moving & ~e["ignition"]).alias("moving_ignition_off"),
    )


def signals_by_persona(signals: DataFrame, personas: DataFrame, codes: list[str]) -> DataFrame:
    """A row for each persona, a column for each code with the number of its signals."""
    return personas.join(signals, "vehicle_id", "left").groupBy("persona").pivot("code", codes).agg(F.count(F.lit(1))).na.fill(0)


def purge_false(alerts: DataFrame, links: DataFrame, cases: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alerts, links and cases without tows of vehicles not towed and tampers of vehicles not tampered with.

    ``truth`` has vehicle_id, towed and tampered. Links go with their alert, and cases that have lost all their alerts.
    """
    judged = alerts.join(truth, "vehicle_id", "left")
    false = judged.where(((F.col("code") == "TOW_SUSPECTED") & ~F.coalesce("towed", F.lit(False))) | ((F.col("code") == "TAMPER_SUSPECTED") & ~F.coalesce("tampered", F.lit(False))))
    kept_alerts = alerts.join(false.select("alert_id"), "alert_id", "left_anti")
    kept_links = links.join(false.select("alert_id"), "alert_id", "left_anti")
    emptied = links.select("case_id").distinct().join(kept_links.select("case_id"), "case_id", "left_anti")
    return kept_alerts, kept_links, cases.join(emptied, "case_id", "left_anti")


def loan_status(days_past_due: Column) -> Column:
    return F.when(days_past_due == 0, "current").when(days_past_due < 90, "overdue").otherwise("default")
