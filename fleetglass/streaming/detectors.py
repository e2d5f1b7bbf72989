"""Detectors, risk and its sinks as streaming queries over the ordered, denoised events that ``pipelines.cleaned`` gives.

What needs no memory is the batch operator itself, joined to static reference tables. What does keeps a small state by
key: the last ten minutes of a vehicle, the run of outside events for a fence, the fading signals of a vehicle. Rows of a
key are put in order within a micro-batch and taken in that order after those of earlier batches. Repeats of an event are
dropped upstream; a repeat that gets here counts as one more event.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import anomaly, fence, risk
from ..operators.folds import arrow_schema
from ..schema import EXIT_AFTER, SIGNAL
from .deviations import deviations
from .pipelines import _Fold, tampers

_FACTS = [x.split(" ")[0] for x in anomaly.FACTS.split(", ")]


class MovementWatch(StatefulProcessor):
    """A vehicle's ``anomaly.movement``: the rows of its last minutes are the state, as typed columns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent, self.seq = handle.getListState("recent", anomaly.MOVED), handle.getValueState("seq", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        frame = pd.concat(list(rows)).sort_values(["device_ts", "seq"], ignore_index=True)
        kept = list(zip(*self.recent.get(), strict=True)) if self.seq.exists() else None
        columns = kept and [np.array(c, dtype=bool if name in ("on", "suspect") else float) for name, c in zip(anomaly.MOVED_NAMES, kept, strict=True)]
        state = anomaly.Movement(columns, self.seq.get()[0] if self.seq.exists() else None)
        at, moved, mean = state.take(*(frame[c].to_numpy() for c in ("seq", *anomaly.MOVED_NAMES)))
        self.recent.put(list(zip(*(c.tolist() for c in state.kept), strict=True)))
        self.seq.update((state.seq,))
        if len(at):
            yield frame.iloc[at].assign(moved_m=moved, avg_kmh=mean)[_FACTS]

    def close(self) -> None:
        pass


class ExitWatch(_Fold):
    """Counts a vehicle's outside events in a row for one fence; the one that reaches ``exit_after`` is a signal."""

    def __init__(self, exit_after: int = EXIT_AFTER) -> None:
        self.exit_after = exit_after
        super().__init__(lambda: {"run": 0}, ["device_ts", "seq"], SIGNAL)

    def take(self, steps: dict, row: dict) -> list[dict]:
        steps["run"] = 0 if row["inside"] else steps["run"] + 1
        if steps["run"] != self.exit_after:
            return []
        return [{"vehicle_id": row["vehicle_id"], "code": "GEOFENCE_EXIT", "ts": row["device_ts"], "lat": row["lat"], "lon": row["lon"], "strength": 1.0, "detail": {"geofence_id": str(row["geofence_id"])}}]


class RiskWatch(StatefulProcessor):
    """Keeps a vehicle's lanes of signals and judges new ones by them."""

    def __init__(self) -> None:
        self.input, self.output = arrow_schema(risk.JUDGED), arrow_schema(risk.DECIDED)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lanes", "value binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        lanes = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else risk.Lanes()
        frame = pd.concat(list(rows)).sort_values(risk.JUDGED_ORDER)
        out = lanes.take(pa.Table.from_pandas(frame[self.input.names], schema=self.input, preserve_index=False))
        self.state.update((pickle.dumps(lanes),))
        yield out.select(self.output.names).to_pandas()

    def close(self) -> None:
        pass


def movement(events: DataFrame) -> DataFrame:
    """The stream's form of ``anomaly.movement``."""
    return anomaly.movement_rows(events).groupBy("vehicle_id").transformWithStateInPandas(MovementWatch(), anomaly.FACTS, "append", "None")


def exits(events: DataFrame, vehicle_fences: DataFrame, fences: DataFrame) -> DataFrame:
    """The stream's form of ``fence.exits``."""
    placed = fence.contained(events.where(fence.trusted()), vehicle_fences, fences)
    slim = placed.select("vehicle_id", "geofence_id", "device_ts", "seq", "lat", "lon", "inside")
    return slim.groupBy("vehicle_id", "geofence_id").transformWithStateInPandas(ExitWatch(), SIGNAL, "append", "None")


def signals(events: DataFrame, vehicle_fences: DataFrame, fences: DataFrame, baselines: DataFrame, delay: str = "10 minutes", answered: DataFrame | None = None) -> DataFrame:
    """Signals of the codes that a vehicle's own events give, with the time at which they fire.

    Route deviations are among them if the stream of answers to the trips' requests is given.

    One state serves towing and speed. Tampering alone looks at the fleet's clock, a watermark of event time with the given
    delay.
    """
    found = [exits(events, vehicle_fences, fences), anomaly.tows_and_spikes(movement(events), baselines), anomaly.night_moves(events, baselines)]
    found += [] if answered is None else [deviations(events, answered)]
    out = tampers(events, delay)
    for part in found:
        out = out.unionByName(part.withColumn("fired_ts", F.col("ts")))
    return out


def decisions(found: DataFrame, loans: DataFrame, open_cases: DataFrame | None = None) -> DataFrame:
    """The stream's form of ``risk.decide``; a signal that comes in a later batch is judged later, whenever it fired."""
    ready = risk.judged(found, loans, open_cases)
    return ready.groupBy("vehicle_id").transformWithStateInPandas(RiskWatch(), risk.DECIDED, "append", "None")


def decision_sink(root: str, loans: DataFrame) -> Callable[[DataFrame, int], None]:
    """Writes a batch's alerts and opened cases; their ids are hashes, and a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        risk.alerts(batch, loans).write.mode("overwrite").parquet(f"{root}/alerts/batch={number}")
        risk.cases(batch, loans).write.mode("overwrite").parquet(f"{root}/cases/batch={number}")
        batch.unpersist()

    return write
