"""Route deviations as a stream: trips ask for their expected path, and the answers come back as a second stream.

The way to a trip's destination takes joins over the road graph's labels, which no stateful operator can make. So two
queries share the work. The first counts each vehicle's trips and asks for a path at every start; its sink answers all starts
of a batch at once and writes the answers to a folder. The second reads events and answers together, keeps the path of the
trip a vehicle is on as state, and tells when the vehicle stays off it.

Every start gets an answer, without points if no way is known, so an event waits no longer than the first query takes; until
then it is state of its vehicle. Answers that come again change nothing. Signals carry the time of the event they are about,
however late its answer comes, and equal those of ``route.deviations``.

Rows of a vehicle are put in order within a micro-batch. Suspect fixes play no part. A vehicle that no baseline knows, or
whose ends no road reaches, gives no signal; empty streams give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import DEGREE_LAT_M, DEGREE_M
from ..operators import reach, route
from ..operators.fence import trusted
from ..operators.hublabels import HubLabels
from ..schema import OFF_PATH_M, OFF_PATH_S, SIGNAL
from ..sources.shared import discard, written

REQUEST = "vehicle_id string, trip long, lat double, lon double"
ANSWER = "vehicle_id string, trip long, lats array<double>, lons array<double>"
_ROW = "device_ts double, seq long, lat double, lon double, trip long"
_ROW_NAMES = [x.split(" ")[0] for x in _ROW.split(", ")]
#: Rows that are held against a path at once, and answers that go to one file.
BLOCK_ROWS, FILE_ROWS = 1024, 1 << 14


def _ignition_runs(ignition: np.ndarray, before: bool) -> np.ndarray:
    """Where the ignition comes on."""
    return ignition & ~np.concatenate([[before], ignition[:-1]])


class TripWatch(StatefulProcessor):
    """Counts a vehicle's trips; each start is a request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trip", "ignition boolean, trip long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        frame = pd.concat(list(rows)).sort_values(["device_ts", "seq"])
        before, trip = self.state.get() or (False, 0)
        ignition = frame["ignition"].to_numpy(dtype=bool)
        starts = _ignition_runs(ignition, before)
        trips = trip + np.cumsum(starts)
        self.state.update((bool(ignition[-1]), int(trips[-1])))
        if starts.any():
            yield frame[starts].assign(trip=trips[starts])[["vehicle_id", "trip", "lat", "lon"]]

    def close(self) -> None:
        pass


class OffPath(StatefulProcessor):
    """Holds a vehicle's driving against the path of its trip; rows of trips without an answer wait in order.

    ``at`` is the trip that was reached last, ``since`` when the vehicle left its path, ``told`` whether a signal went out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("standing", "ignition boolean, trip long, at long, since double, told boolean")
        self.paths = handle.getMapState("paths", "trip long", "lats array<double>, lons array<double>")
        self.waiting = handle.getListState("waiting", _ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        frame = pd.concat(list(rows))
        ignition, trip, at, since, told = self.state.get() or (False, 0, 0, None, False)
        answers, events = frame[frame["trip"].notna()], frame[frame["trip"].isna()].sort_values(["device_ts", "seq"])
        # each call of the state is a message to the executor, so what this batch brings is put there only if it must stay
        stored, fresh = {k[0] for k in self.paths.keys()}, {}
        for n, lats, lons in zip(answers["trip"], answers["lats"], answers["lons"], strict=True):
            if n >= at and int(n) not in stored:
                fresh.setdefault(int(n), ([float(x) for x in lats], [float(x) for x in lons]))
        held = list(self.waiting.get()) if self.waiting.exists() else []
        rest = pd.DataFrame(held, columns=_ROW_NAMES)
        if len(events):
            on = events["ignition"].to_numpy(dtype=bool)
            trips = trip + np.cumsum(_ignition_runs(on, ignition))
            ignition, trip = bool(on[-1]), int(trips[-1])
            events = events.assign(trip=trips)[on][_ROW_NAMES].astype({"trip": "int64", "seq": "int64"})
            rest = pd.concat([rest, events], ignore_index=True) if held else events
        out, new = [], len(rest) - len(held)
        while len(rest) and ((n := int(rest["trip"].iloc[0])) in stored or n in fresh):
            if n != at:
                at, since, told = n, None, False
            own = rest[rest["trip"] == n]
            found, since = self._follow(own, *(fresh[n] if n in fresh else self.paths.getValue((n,))), since)
            if found and not told:
                told = True
                out.append((key[0], "ROUTE_DEVIATION", *found[:3], 1.0, {"off_path_s": str(found[3])}))
            rest = rest.iloc[len(own) :]
        for n in stored:
            if n < at:
                self.paths.removeKey((n,))
        for n, path in fresh.items():
            if n >= at:
                self.paths.updateValue((n,), path)
        left = [tuple(r) for r in rest.astype(object).itertuples(index=False)]
        if len(left) == len(held) + new:
            if new:
                self.waiting.appendList(left[len(held) :])
        elif left:
            self.waiting.put(left)
        elif held:
            self.waiting.clear()
        self.state.update((ignition, trip, at, since, told))
        if out:
            yield pd.DataFrame(out, columns=["vehicle_id", "code", "ts", "lat", "lon", "strength", "detail"])

    @staticmethod
    def _follow(rows: pd.DataFrame, lats: list[float], lons: list[float], since: float | None) -> tuple[tuple | None, float | None]:
        """The first row off the path for long enough (ts, lat, lon, seconds), and since when the last row is off."""
        if not len(lats):
            return None, None
        ts, lat, lon = (rows[c].to_numpy(dtype=float) for c in ("device_ts", "lat", "lon"))
        to_lat, to_lon, near = np.asarray(lats), np.asarray(lons), np.empty(len(ts))
        for a in range(0, len(ts), BLOCK_ROWS):
            la, lo = lat[a : a + BLOCK_ROWS, None], lon[a : a + BLOCK_ROWS, None]
            dx, dy = (to_lon - lo) * DEGREE_M * np.cos(np.radians(la)), (to_lat - la) * DEGREE_LAT_M
            near[a : a + BLOCK_ROWS] = np.sqrt(dx * dx + dy * dy).min(axis=1)
        off, place = near > OFF_PATH_M, np.arange(len(ts))
        back = np.maximum.accumulate(np.where(off, -1, place))
        left = ts[np.minimum(back + 1, len(ts) - 1)]
        if since is not None:
            left = np.where(back < 0, since, left)
        long = np.flatnonzero(off & (ts - left >= OFF_PATH_S))
        found = None if not len(long) else (float(ts[long[0]]), float(lat[long[0]]), float(lon[long[0]]), round(float(ts[long[0]] - left[long[0]])))
        return found, float(left[-1]) if off[-1] else None

    def close(self) -> None:
        pass


def trip_requests(events: DataFrame) -> DataFrame:
    """A stream of ordered, denoised events as a request for every trip start: vehicle_id, trip, lat, lon."""
    slim = events.where(trusted()).select("vehicle_id", "device_ts", "seq", "lat", "lon", "ignition")
    return slim.groupBy("vehicle_id").transformWithStateInPandas(TripWatch(), REQUEST, "append", "None")


def path_sink(spark: SparkSession, root: str, baselines: DataFrame, nodes: DataFrame, labels: HubLabels | DataFrame) -> Callable[[DataFrame, int], None]:
    """Answers a batch of requests; a repeated batch finds its answers there, as readers may have seen them already.

    ``labels`` are those of all nodes, for streams of many small batches, or the edges; then batches share what is known of
    the graph, and each one's ways are searched in the part that its requests' ends need.
    """
    files = _files(spark, root)
    town = reach.Town(nodes, labels) if isinstance(labels, DataFrame) else labels
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def write(batch: DataFrame, number: int) -> None:
        out = f"{root}/batch={number}"
        if files.exists(path(f"{out}/_SUCCESS")):
            return
        asked = written(batch, "starts")
        # a stream's own session plans without what the rows tell, so the answers are worked out in the caller's
        starts = spark.read.schema(asked.schema).parquet(*asked.inputFiles())
        n = starts.count()
        if not n:
            return
        found = route.trip_paths(starts, baselines, nodes, town)
        of = lambda name: F.coalesce(F.transform("points", lambda p: p[name]), F.array().cast("array<double>")).alias(f"{name}s")
        answered = starts.join(found, ["vehicle_id", "trip"], "left").select("vehicle_id", "trip", of("lat"), of("lon"))
        # readers may take a file a batch, so there are as many as the answers ask for and not as the join has tasks
        answered.repartition(-(-n // FILE_ROWS), "vehicle_id", "trip").write.mode("overwrite").parquet(out)
        discard(asked)

    return write


def _files(spark: SparkSession, root: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    return files


def answers(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The stream of answers that ``path_sink`` writes."""
    _files(spark, root)
    return spark.readStream.schema(ANSWER + ", batch long").options(**options).parquet(root).drop("batch")


def deviations(events: DataFrame, answered: DataFrame) -> DataFrame:
    """The stream's form of ``route.deviations``, from events and the answers to their trips' requests."""
    nothing = F.lit(None).cast("array<double>")
    rows = events.where(trusted()).select("vehicle_id", "device_ts", "seq", "lat", "lon", "ignition", F.lit(None).cast("long").alias("trip"), nothing.alias("lats"), nothing.alias("lons"))
    both = rows.unionByName(answered.select(*[x.split(" ")[0] for x in ANSWER.split(", ")]), allowMissingColumns=True)
    return both.groupBy("vehicle_id").transformWithStateInPandas(OffPath(), SIGNAL, "append", "None")
