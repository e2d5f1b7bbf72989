"""Risk scores from fading signals, alerts with a cooldown, recovery cases."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CASE_SCORE, COOLDOWN_S, DECAY_S, MAX_DPD, ORDINALS, SIGNAL, WEIGHTS
from .folds import fold_tables, key_codes


def weight(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in WEIGHTS.items())), code), F.lit(0.0))


def ordinal(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ORDINALS.items())), code), F.lit(99))


def multiplier(days_past_due: Column) -> Column:
    """1 for a current or no loan, up to 2 from 90 days past due."""
    return 1 + F.least(F.coalesce(days_past_due, F.lit(0)), F.lit(MAX_DPD)) / MAX_DPD


def fade(age_s: Column) -> Column:
    """What a day leaves of a signal, in a straight line; more than 1 for one from the future."""
    return F.greatest(F.lit(0.0), 1 - age_s / DECAY_S)


def standing(strength: list[float], ts: list[float], before: tuple[float, float] | None) -> list[tuple[float, float]]:
    """For one code's signals in order the one that counts after each: a newer one takes over unless it is weaker than what is left of the old."""
    out = []
    for new in zip(strength, ts, strict=True):
        left = before[0] * max(0.0, 1 - (new[1] - before[1]) / DECAY_S) if before else 0.0
        before = new if before is None or new[0] >= left else before
        out.append(before)
    return out


def spaced(ts: list[float], last: float) -> tuple[list[bool], float]:
    """Which moments are at least COOLDOWN_S after the last one chosen."""
    out = []
    for t in ts:
        out.append(t - last >= COOLDOWN_S)
        last = t if out[-1] else last
    return out, last


class Lanes:
    """A vehicle's signals in lanes, one for each code: what counts there and which alerts are due follows lane by lane.

    The score at a row takes from every lane what counted last, all rows of a vehicle at once. Between tables only the ends
    of the lanes are kept.
    """

    def __init__(self) -> None:
        self.vehicle = None

    def _vehicle(self, rows: pa.Table) -> tuple[np.ndarray, ...]:
        n = rows.num_rows
        ts, strength = (rows[c].to_numpy() for c in ("ts", "strength"))
        coded = rows["code"].combine_chunks().dictionary_encode()
        which, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        days = np.minimum(np.nan_to_num(rows["days_past_due"].to_numpy().astype(float)), MAX_DPD)
        total, alert, active = np.zeros(n), np.zeros(n, dtype=bool), np.zeros((n, 2))
        for code in dict.fromkeys([*self.ends, *names]):
            at = np.flatnonzero(which == names.index(code)) if code in names else np.zeros(0, dtype=np.int64)
            own = np.array([self.ends.get(code, (0.0, -np.inf)), *standing(strength[at].tolist(), ts[at].tolist(), self.ends.get(code))])
            active[at] = own[1:]
            if len(at):
                self.ends[code] = tuple(own[-1].tolist())
                alert[at], self.alerted[code] = spaced(ts[at].tolist(), self.alerted.get(code, -np.inf))
            counts = own[np.searchsorted(at, np.arange(n), "right")]
            total += WEIGHTS.get(code, 0) * counts[:, 0] * np.maximum(0.0, 1 - (ts - counts[:, 1]) / DECAY_S)
        score = np.array([round(x, 2) for x in np.minimum(100.0, total * (1 + days / MAX_DPD)).tolist()])
        known = self.case | np.maximum.accumulate(rows["case_open"].to_numpy(zero_copy_only=False).astype(bool))
        opens = (score > CASE_SCORE) & ~known
        opens[np.flatnonzero(opens)[1:]] = False
        self.case = bool(known[-1] or opens.any())
        return score, alert, opens, active

    def take(self, table: pa.Table) -> pa.Table | None:
        names, starts = key_codes(table)
        parts = []
        for vehicle, a, b in zip(names, starts.tolist(), starts[1:].tolist(), strict=False):
            if vehicle != self.vehicle:
                self.vehicle, self.ends, self.alerted, self.case = vehicle, {}, {}, False
            parts.append(self._vehicle(table.slice(a, b - a)))
        if not parts:
            return None
        score, alert, opens, active = (np.concatenate(x) for x in zip(*parts, strict=True))
        made = {"score": score, "write_alert": alert, "open_case": opens, "active_strength": active[:, 0], "active_ts": active[:, 1]}
        for name, column in made.items():
            table = table.append_column(name, pa.array(column))
        return table

    def end(self) -> None:
        return None


DECIDED = SIGNAL.replace("detail map<string,string>", "detail string") + ", fired_ts double, days_past_due int, case_open boolean, score double, write_alert boolean, open_case boolean, active_strength double, active_ts double"


JUDGED = SIGNAL.replace("detail map<string,string>", "detail string") + ", fired_ts double, days_past_due int, case_open boolean, kind int, tie string"
#: Order in which a vehicle's signals are judged.
JUDGED_ORDER = ["fired_ts", "kind", "tie"]


def judged(signals: DataFrame, loans: DataFrame, open_cases: DataFrame | None = None) -> DataFrame:
    """Signals with what judging them needs: days past due, whether a case is open, and the columns that order them."""
    timed = signals if "fired_ts" in signals.columns else signals.withColumn("fired_ts", F.col("ts"))
    due = timed.join(loans.where("status <> 'closed'").select("vehicle_id", "days_past_due"), "vehicle_id", "left")
    case = F.lit(False)
    if open_cases is not None:
        due = due.join(open_cases.select("vehicle_id", F.lit(True).alias("_case")).distinct(), "vehicle_id", "left")
        case = F.coalesce("_case", F.lit(False))
    return due.select("vehicle_id", "code", "ts", "lat", "lon", "strength", F.to_json("detail").alias("detail"), F.coalesce("fired_ts", "ts").alias("fired_ts"), F.coalesce(F.col("days_past_due").cast("int"), F.lit(0)).alias("days_past_due"), case.alias("case_open"), ordinal(F.col("code")).alias("kind"), F.col("detail").cast("string").alias("tie"))


def decide(signals: DataFrame, loans: DataFrame, open_cases: DataFrame | None = None) -> DataFrame:
    """Every signal in order with score, write_alert and open_case; detail as JSON.

    Signals of a vehicle are taken by the time at which they fire, then by their kind. A signal without ``fired_ts`` fires
    at its own time. ``loans`` has at most one open loan for each vehicle; ``open_cases`` has vehicle_id.
    """
    kept = [x.split(" ")[0] for x in DECIDED.split(", ")]
    return fold_tables(judged(signals, loans, open_cases), ["vehicle_id"], JUDGED_ORDER, Lanes, DECIDED).select(*kept)


def active_signals(decided: DataFrame) -> DataFrame:
    """The signal that counts for each vehicle and code after all rows: strength and ts."""
    last = F.max_by(F.struct("active_strength", "active_ts"), F.struct("fired_ts", "ts"))
    return decided.groupBy("vehicle_id", "code").agg(last.alias("a")).select("vehicle_id", "code", F.col("a.active_strength").alias("strength"), F.col("a.active_ts").alias("ts"))


def rescore(active: DataFrame, loans: DataFrame, now) -> DataFrame:
    """vehicle_id and score at ``now`` of vehicles whose score is not zero."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    summed = active.groupBy("vehicle_id").agg(F.sum(weight(F.col("code")) * F.col("strength") * fade(now - F.col("ts"))).alias("_total"))
    due = summed.join(loans.where("status <> 'closed'").select("vehicle_id", "days_past_due"), "vehicle_id", "left")
    return due.select("vehicle_id", F.bround(F.least(F.lit(100.0), F.col("_total") * multiplier(F.col("days_past_due"))), 2).alias("score")).where("score > 0")


def alerts(decided: DataFrame, loans: DataFrame) -> DataFrame:
    """Alert rows with the lender of the open loan; the id is a hash of vehicle, code and time."""
    rows = decided.where("write_alert").join(loans.where("status <> 'closed'").select("vehicle_id", "lender_id", "loan_id"), "vehicle_id", "left")
    return rows.select(F.xxhash64("vehicle_id", "code", "ts").alias("alert_id"), F.col("ts").alias("created_ts"), "lat", "lon", F.col("score").cast("decimal(5,2)").alias("risk_score"), "vehicle_id", "code", "lender_id", "loan_id", "detail", "open_case")


def cases(decided: DataFrame, loans: DataFrame) -> DataFrame:
    """A case for each vehicle with a loan whose score crosses the threshold while none is open, with the crossing alert."""
    rows = decided.where("open_case").join(loans.where("status <> 'closed'").select("vehicle_id", "loan_id"), "vehicle_id")
    case_id = F.xxhash64("loan_id", "ts")
    return rows.select(case_id.alias("case_id"), F.col("ts").alias("opened_ts"), F.lit("open").alias("status"), "loan_id", "vehicle_id", F.xxhash64("vehicle_id", "code", "ts").alias("alert_id"))


def counters(alert_rows: DataFrame, case_rows: DataFrame) -> DataFrame:
    """name and n: alerts by code, and opened cases (0 if there are none)."""
    by_code = alert_rows.groupBy("code").agg(F.count("*").alias("n")).select(F.concat(F.lit("alert."), F.col("code")).alias("name"), "n")
    return by_code.unionByName(case_rows.agg(F.count("*").alias("n")).select(F.lit("cases_opened").alias("name"), "n"))


def breakdown(alert_rows: DataFrame, loans: DataFrame, now: float) -> DataFrame:
    """For each vehicle the parts of its score by code, from the newest alert of each, and the multiplier."""
    newest = alert_rows.groupBy("vehicle_id", "code").agg(F.max("created_ts").alias("ts"))
    # weight times what is left of a day, divided last, so that a tie between two tenths is exact and goes to the even one
    left = F.greatest(F.lit(0.0), F.lit(float(DECAY_S)) - (F.lit(float(now)) - F.col("ts")))
    parts = newest.withColumn("part", F.rint(weight(F.col("code")) * 10 * left / DECAY_S) / 10)
    grouped = parts.groupBy("vehicle_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "part")))).alias("parts"))
    due = grouped.join(loans.where("status <> 'closed'").select("vehicle_id", "days_past_due"), "vehicle_id", "left")
    return due.select("vehicle_id", "parts", F.bround(multiplier(F.col("days_past_due")), 2).alias("multiplier"))
