"""Towing, night driving, speed spikes and tampering from each vehicle's last ten minutes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..schema import (
    DROP_V, LOCAL_OFFSET_S, LOW_V, MOVING_KMH, NIGHT_FROM, NIGHT_TO, SIGNAL, SILENCE_S, SPIKE_POINTS, SPIKE_STD, SUSPECT, TOW_FULL_M, TOW_M, TOW_POINTS, WINDOW_S,
)
from .fence import signal_columns
from .folds import fold_tables, key_codes


def with_session(events: DataFrame) -> DataFrame:
    """Adds ``session``: how often seq fell before this event of the vehicle."""
    order = Window.partitionBy("vehicle_id").orderBy("device_ts", "seq")
    fell = F.coalesce((F.col("seq") < F.lag("seq").over(order)).cast("int"), F.lit(0))
    return events.withColumn("_fell", fell).withColumn("session", F.sum("_fell").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")


def with_window(events: DataFrame, seconds: int = WINDOW_S) -> DataFrame:
    """Adds ``recent``: the session's points up to this event, at most ``seconds`` old, in order."""
    frame = Window.partitionBy("vehicle_id", "session").orderBy("device_ts").rangeBetween(-seconds, 0)
    point = F.struct(F.col("device_ts").alias("ts"), "seq", "lat", "lon", F.col("speed_kmh").alias("speed"), F.col("ignition").alias("on"), F.array_contains("flags", SUSPECT).alias("suspect"))
    collected = with_session(events).withColumn("_all", F.collect_list(point).over(frame))
    ordered = F.array_sort(F.filter("_all", lambda p: (p["ts"] < F.col("device_ts")) | (p["seq"] <= F.col("seq"))))
    return collected.withColumn("recent", ordered).drop("_all")


def _window_starts(ts: np.ndarray, first: int, fell: np.ndarray) -> np.ndarray:
    """Where the window of each row from ``first`` on begins: in its session (``fell`` begins one), at most ``WINDOW_S`` back."""
    place = np.arange(first, len(ts))
    begun = np.maximum.accumulate(np.where(fell, place, 0))
    return np.minimum(np.maximum(begun, np.searchsorted(np.maximum.accumulate(ts), ts[first:] - WINDOW_S)), place)


def _metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    s, t = np.sin((p2 - p1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * np.arcsin(np.sqrt(s * s + np.cos(p1) * np.cos(p2) * t * t))


#: What a row must tell about itself, in the order in which ``Movement`` keeps it.
MOVED = "device_ts double, lat double, lon double, speed_kmh double, on boolean, suspect boolean"
MOVED_NAMES = [x.split(" ")[0] for x in MOVED.split(", ")]
FACTS = "vehicle_id string, device_ts double, seq long, lat double, lon double, moved_m double, avg_kmh double"


class Movement:
    """How far a vehicle was carried and how fast it drove in its last minutes, for columns of rows in order.

    Windows are pairs of positions in the columns, found by binary search, and what is asked of them is looked up by position:
    no row holds its window. Between calls only the rows of the last minutes stay.
    """

    def __init__(self, kept: list[np.ndarray] | None = None, seq: int | None = None) -> None:
        self.kept = kept or [np.zeros(0)] * 4 + [np.zeros(0, dtype=bool)] * 2
        self.seq = seq

    def take(self, seq: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (``MOVED``) with something to tell: their positions, metres carried and mean speed, NaN where there is none."""
        first, n = len(self.kept[0]), len(seq)
        ts, lat, lon, speed, on, suspect = now = [np.concatenate(x) for x in zip(self.kept, rows, strict=True)]
        lo = _window_starts(ts, first, seq < np.concatenate([[seq[0] if self.seq is None else self.seq], seq[:-1]]))
        carried, mean = np.full(n, np.nan), np.full(n, np.nan)
        self._carried(carried, lo, first, lat, lon, on, suspect)
        self._driven(mean, lo, first, speed, suspect)
        self.kept, self.seq = [c[lo[-1] :] for c in now], int(seq[-1])
        at = np.flatnonzero(~np.isnan(carried) | ~np.isnan(mean))
        return at, carried[at], mean[at]

    @staticmethod
    def _carried(out: np.ndarray, lo: np.ndarray, first: int, lat: np.ndarray, lon: np.ndarray, on: np.ndarray, suspect: np.ndarray) -> None:
        """Metres from where the run of trusted points since the ignition went off began, if plausible and lasting."""
        place, trusted_at = np.arange(first, len(on)), np.flatnonzero(~suspect)
        lit = np.maximum.accumulate(np.where(on, np.arange(len(on)), -1))[first:]
        a, b = np.searchsorted(trusted_at, np.maximum(lo, lit + 1)), np.searchsorted(trusted_at, place, "right")
        rows = np.flatnonzero(~on[first:] & ~suspect[first:] & (b - a >= 2 * TOW_POINTS))
        if not len(rows):
            return
        three = np.arange(TOW_POINTS)
        oldest, newest = trusted_at[a[rows, None] + three], trusted_at[b[rows, None] - TOW_POINTS + three]
        from_lat, from_lon = np.median(lat[oldest], axis=1), np.median(lon[oldest], axis=1)
        moved = _metres(from_lat, from_lon, lat[first + rows], lon[first + rows])
        away = (_metres(from_lat[:, None], from_lon[:, None], lat[newest], lon[newest]) > TOW_M / 2).all(axis=1)
        steps = (_metres(lat[newest[:, :-1]], lon[newest[:, :-1]], lat[newest[:, 1:]], lon[newest[:, 1:]]) <= TOW_M).all(axis=1)
        sure = (moved > TOW_M) & away & steps
        out[rows[sure]] = moved[sure]

    @staticmethod
    def _driven(out: np.ndarray, lo: np.ndarray, first: int, speed: np.ndarray, suspect: np.ndarray) -> None:
        """The mean speed of the window's moving points, if there are enough. Sums are the windows' own, so that equal speeds have exactly their mean."""
        moving = np.flatnonzero((speed >= MOVING_KMH) & ~suspect)
        a, b = np.searchsorted(moving, lo), np.searchsorted(moving, np.arange(first, len(speed)), "right")
        rows = np.flatnonzero(b - a >= SPIKE_POINTS)
        if len(rows):
            ends = np.column_stack([a[rows], b[rows]]).ravel()
            out[rows] = np.add.reduceat(np.append(speed[moving], 0.0), ends)[::2] / (b - a)[rows]


def movement_rows(events: DataFrame) -> DataFrame:
    on, suspect = F.coalesce("ignition", F.lit(False)).alias("on"), F.array_contains("flags", SUSPECT).alias("suspect")
    return events.select("vehicle_id", "seq", "device_ts", "lat", "lon", "speed_kmh", on, suspect)


class _Movements:
    """``Movement`` vehicle by vehicle over a task's sorted rows."""

    def __init__(self) -> None:
        self.vehicle, self.state = None, Movement()

    def take(self, table: pa.Table) -> pa.Table:
        names, starts = key_codes(table)
        seq, *rows = (table[c].to_numpy() for c in ("seq", *MOVED_NAMES))
        found = []
        for vehicle, a, b in zip(names, starts.tolist(), starts[1:].tolist(), strict=False):
            if vehicle != self.vehicle:
                self.vehicle, self.state = vehicle, Movement()
            at, moved, mean = self.state.take(seq[a:b], *(c[a:b] for c in rows))
            found.append((at + a, moved, mean))
        at, moved, mean = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0)] * 3
        out = table.take(pa.array(at.astype(np.int64)))
        return out.append_column("moved_m", pa.array(moved, from_pandas=True)).append_column("avg_kmh", pa.array(mean, from_pandas=True))

    def end(self) -> None:
        return None


def movement(events: DataFrame) -> DataFrame:
    """``FACTS`` of the events that a tow or a speed spike could be seen at, from the vehicle's last minutes in its session.

    ``moved_m`` is null unless the vehicle was carried off with its ignition off, ``avg_kmh`` unless enough points moved. One
    fold in bounded memory serves both; rows with equal time and seq see those before them.
    """
    return fold_tables(movement_rows(events), ["vehicle_id"], ["device_ts", "seq"], _Movements, FACTS)


def _tow() -> list[Column]:
    return signal_columns(F.lit("TOW_SUSPECTED"), F.least(F.lit(1.0), F.col("moved_m") / TOW_FULL_M), F.create_map(F.lit("moved_m"), F.bround("moved_m").cast("long").cast("string")))


def _spike() -> list[Column]:
    detail = F.create_map(F.lit("avg_kmh"), F.bround("avg_kmh").cast("long").cast("string"), F.lit("limit_kmh"), F.bround("_limit").cast("long").cast("string"))
    return signal_columns(F.lit("SPEED_SPIKE"), F.lit(1.0), detail)


def _with_limit(facts: DataFrame, baselines: DataFrame) -> DataFrame:
    limit = (F.col("avg_speed") + SPIKE_STD * F.col("std_speed")).alias("_limit")
    return facts.join(baselines.select("vehicle_id", limit), "vehicle_id", "left")


def tows(facts: DataFrame) -> DataFrame:
    """TOW_SUSPECTED: ignition off, yet displaced from where the run of points began, plausibly and lastingly."""
    return facts.where("moved_m IS NOT NULL").select(*_tow())


def night_moves(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """NIGHT_MOVEMENT: driving between 0 and 5 local time, outside the vehicle's usual hours."""
    hour = F.pmod(F.col("device_ts") + LOCAL_OFFSET_S, F.lit(86_400.0)) / 3600
    driving = events.withColumn("_hour", hour).where((F.col("_hour") >= NIGHT_FROM) & (F.col("_hour") < NIGHT_TO) & F.col("ignition") & (F.col("speed_kmh") >= MOVING_KMH))
    joined = driving.join(baselines.select("vehicle_id", "active_from", "active_to"), "vehicle_id", "left")
    usual = F.coalesce((F.col("_hour") >= F.col("active_from")) & (F.col("_hour") < F.col("active_to")), F.lit(False))
    return joined.where(~usual).select(*signal_columns(F.lit("NIGHT_MOVEMENT"), F.lit(1.0), F.create_map(F.lit("local_hour"), F.floor("_hour").cast("string"))))


def speed_spikes(facts: DataFrame, baselines: DataFrame) -> DataFrame:
    """SPEED_SPIKE: the window's mean moving speed is above the vehicle's mean by three deviations."""
    return _with_limit(facts.where("avg_kmh IS NOT NULL"), baselines).where("avg_kmh > _limit").select(*_spike())


def tows_and_spikes(facts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Both kinds of signals in one pass over the facts, as a stream's state can't be shared between branches."""
    both = F.array(F.when(F.col("moved_m").isNotNull(), F.struct(*_tow())), F.when(F.col("avg_kmh") > F.col("_limit"), F.struct(*_spike())))
    return _with_limit(facts, baselines).select(F.inline(F.array_compact(both)))


def _peaks(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of values[lo:hi] for every pair, from maxima over stretches of 1, 2, 4, ... values."""
    level = np.log2(hi - lo).astype(np.int64)
    out, best = np.empty(len(lo)), values
    for k in range(int(level.max(initial=0)) + 1):
        at = level == k
        out[at] = np.maximum(best[lo[at]], best[hi[at] - (1 << k)])
        best = np.maximum(best[: max(0, len(best) - (1 << k))], best[1 << k :])
    return out


class Silence:
    """What a vehicle's silence would tell: the odd moment that a signal would name, by columns of rows in order.

    A row is odd if its fix is suspect, its voltage low, or well below the session's best of the last minutes. Rows without a
    long gap or a new session between them form a burst; in a burst the first odd row stands until it is too old, then the
    next odd one beyond that. A long gap after a burst turns what stands into a signal.
    """

    def __init__(self) -> None:
        self.ts, self.volts = np.zeros(0), np.zeros(0)  # the session's last minutes
        self.seq: int | None = None
        self.point: tuple[float, float, float] | None = None

    @property
    def due(self) -> float | None:
        """When silence would be long enough for a signal."""
        return None if self.point is None else float(self.ts[-1]) + SILENCE_S

    def until(self, now: float) -> list[tuple]:
        """The signal (ts, lat, lon, silent seconds, fired_ts) if nothing came until now."""
        if self.due is None or now < self.due:
            return []
        (ts, lat, lon), due, self.point = self.point, self.due, None
        return [(ts, lat, lon, round(now - due + SILENCE_S), due)]

    def take(self, ts: np.ndarray, seq: np.ndarray, lat: np.ndarray, lon: np.ndarray, volts: np.ndarray, suspect: np.ndarray) -> list[tuple]:
        n, kept = len(ts), len(self.ts)
        before = np.concatenate([self.ts[-1:] if kept else ts[:1], ts[:-1]])
        fell = seq < np.concatenate([[seq[0] if self.seq is None else self.seq], seq[:-1]])
        every, all_volts = np.concatenate([self.ts, ts]), np.concatenate([self.volts, volts])
        lo = _window_starts(every, kept, fell)
        odd = suspect | (volts < LOW_V) | (_peaks(all_volts, lo, np.arange(n) + kept + 1) - volts >= DROP_V)
        out, cuts = [], np.flatnonzero(fell | (ts - before >= SILENCE_S))
        for a, z in zip(np.unique([0, *cuts]).tolist(), [*np.unique([0, *cuts]).tolist()[1:], n], strict=True):
            out += self.until(float(ts[a])) if kept or a else []
            self.point = None if fell[a] else self.point
            self._stand(a + np.flatnonzero(odd[a:z]), ts, lat, lon, float(ts[z - 1]))
            self.ts = ts[z - 1 : z]
        self.ts, self.volts, self.seq = every[lo[-1] :], all_volts[lo[-1] :], int(seq[-1])
        return out

    def _stand(self, odd: np.ndarray, ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, end: float) -> None:
        times = ts[odd]
        at = 0 if self.point is None else int(np.searchsorted(times, self.point[0] + SILENCE_S, "right"))
        while at < len(odd):
            self.point = tuple(float(x[odd[at]]) for x in (ts, lat, lon))
            at = int(np.searchsorted(times, self.point[0] + SILENCE_S, "right"))
        if self.point and end - self.point[0] > SILENCE_S:
            self.point = None


TAMPER = SIGNAL.replace("detail map<string,string>", "silent_s long") + ", fired_ts double"
_READ = ("device_ts", "seq", "lat", "lon", "battery_v", "suspect")


def silent_table(vehicle: list[str], found: list[tuple]) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [()] * 5
    code, strength = ["TAMPER_SUSPECTED"] * len(found), [1.0] * len(found)
    kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
    made = (vehicle, code, columns[0], columns[1], columns[2], strength, columns[3], columns[4])
    return pa.table([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], ["vehicle_id", "code", "ts", "lat", "lon", "strength", "silent_s", "fired_ts"])


class _Silences:
    """``Silence`` vehicle by vehicle over a task's sorted rows, each one's end judged by the fleet's clock."""

    def __init__(self) -> None:
        self.vehicle, self.state, self.clock = None, Silence(), 0.0

    def take(self, table: pa.Table) -> pa.Table | None:
        names, starts = key_codes(table)
        columns = [table[c].to_numpy() for c in _READ]
        of, found = [], []
        for vehicle, a, b in zip(names, starts.tolist(), starts[1:].tolist(), strict=False):
            if vehicle != self.vehicle:
                rest = self.state.until(self.clock)
                of, found = of + [self.vehicle] * len(rest), found + rest
                self.vehicle, self.state = vehicle, Silence()
            now = self.state.take(*(c[a:b] for c in columns))
            of, found = of + [vehicle] * len(now), found + now
            self.clock = table["clock"][a].as_py()
        return silent_table(of, found)

    def end(self) -> pa.Table | None:
        rest = self.state.until(self.clock)
        return silent_table([self.vehicle] * len(rest), rest)


def tamper_signals(silent: DataFrame) -> DataFrame:
    """Signals from rows of ``TAMPER``."""
    detail = F.create_map(F.lit("silent_s"), F.col("silent_s").cast("string"))
    return silent.select("vehicle_id", "code", "ts", "lat", "lon", "strength", detail.alias("detail"), "fired_ts")


def tamper_rows(events: DataFrame) -> DataFrame:
    return events.select("vehicle_id", "device_ts", "seq", "lat", "lon", "battery_v", F.array_contains("flags", SUSPECT).alias("suspect"))


def tampers(events: DataFrame) -> DataFrame:
    """TAMPER_SUSPECTED: an odd moment, then silence until the next event or the newest event of the fleet.

    ``fired_ts`` is when the silence was long enough; the signal itself has the time of the odd moment.
    """
    clock = events.agg(F.max("device_ts").alias("clock"))
    timed = tamper_rows(events).join(F.broadcast(clock))  # one row
    return tamper_signals(fold_tables(timed, ["vehicle_id"], ["device_ts", "seq"], _Silences, TAMPER))
