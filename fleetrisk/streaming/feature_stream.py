"""Row-count features and forward labels on streams of hourly rows (WN1-WN5, FN12), with keyed state.

* ``feature_stream``: trailing means, deviations and alarm counts over the last 6, 24 and 168 rows and hours since the last alarm.
  State per inverter: the last 167 rows and the time of the last alarm; it can start from a stored table (``history``) and may expire.
* ``label_stream``: forward targets. A row's label is complete once 168 rows are there; rows that arrive late revise labels that were
  given out. Where an inverter falls silent, event-time timers give out what its rows have so far.

Both equal the batch operators on a replay of the same rows. They run on ``transformWithState``, whose state lives in RocksDB and
in the query's checkpoint, so a restarted query or a lost executor goes on from there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import kpi
from ..operators.features import min_periods
from ..schema import NO_ALARM_HOURS, ROLLING_COLS, WINDOWS
from ..session import ship_package

# processors travel by value: the runner that starts a stateful query has no access to files added to the session
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = max(WINDOWS.values())
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_US = 3_600_000_000


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB state store and the package on the workers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship_package(spark)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


class _Features(StatefulProcessor):
    """Per inverter: the last rows (time, alarm flag, signals) and the last alarm."""

    def __init__(self, signals: Sequence[str], frames: dict[str, tuple[int, int]], ttl_ms: int | None):
        self.signals, self.frames, self.ttl_ms = list(signals), frames, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ["at long", "alarm int", *(f"s{i} double" for i in range(len(self.signals)))]
        self.rows = handle.getListState("rows", ", ".join(fields), self.ttl_ms)
        self.last = handle.getValueState("last_alarm", "at long", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = initialState.sort_values("datetime")
        self._keep(self._frame(held))
        if held["last_alarm"].notna().any():
            self.last.update((int(_micros(held["last_alarm"].dropna()).max()),))

    def _frame(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"at": _micros(pdf["datetime"]), "alarm": pdf["alarm_active"].to_numpy(np.int64)}
        return pd.DataFrame(out | {f"s{i}": pdf[c].to_numpy(np.float64) for i, c in enumerate(self.signals)})

    def _keep(self, rows: pd.DataFrame) -> None:
        tail = rows.tail(LONGEST - 1).astype({"at": np.int64, "alarm": np.int64})
        values = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in zip(*(tail[c].tolist() for c in tail.columns))]
        if values:
            self.rows.put(values)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("datetime", kind="stable")
        names = ["at", "alarm", *(f"s{i}" for i in range(len(self.signals)))]
        held = pd.DataFrame(list(self.rows.get()), columns=names)
        if len(held):
            new = new[_micros(new["datetime"]) > held["at"].max()]
        if not len(new):
            return
        fresh = self._frame(new)
        every = pd.concat([held.astype(fresh.dtypes), fresh], ignore_index=True) if len(held) else fresh
        n = len(held)
        out = new.reset_index(drop=True)
        for i, c in enumerate(self.signals):
            for name, (w, least) in self.frames.items():
                r = every[f"s{i}"].rolling(w, min_periods=least)
                out[f"{c}_{name}_mean"] = r.mean().to_numpy()[n:]
                out[f"{c}_{name}_std"] = r.std().to_numpy()[n:]
        run = np.concatenate([[0], np.cumsum(every["alarm"].to_numpy())])
        at = np.arange(n, len(every)) + 1
        out["alarm_count_24h"] = (run[at] - run[np.maximum(at - 24, 0)]).astype(float)
        out["alarm_count_7d"] = (run[at] - run[np.maximum(at - 168, 0)]).astype(float)
        before = self.last.get()[0] if self.last.exists() else -1
        last = np.maximum(np.maximum.accumulate(np.where(fresh["alarm"] == 1, fresh["at"], -1)), before)
        out["hours_since_last_alarm"] = np.where(last >= 0, (fresh["at"] - last) / HOUR_US, NO_ALARM_HOURS)
        if last[-1] >= 0:
            self.last.update((int(last[-1]),))
        self._keep(every)
        yield out

    def close(self) -> None:
        pass


def _with_flag(hourly: DataFrame) -> DataFrame:
    flag = kpi.alarm_active(F.col("inv_alarm_code")) if "inv_alarm_code" in hourly.columns else F.lit(0)
    return hourly.withColumn("alarm_active", flag.cast("int"))


def history(hourly: DataFrame, key: str = "inverter_id") -> DataFrame:
    """What ``feature_stream`` starts from: each inverter's last 167 rows of a stored hourly table, and its last alarm (``last_alarm``)."""
    rows = _with_flag(hourly)
    newest = Window.partitionBy(key).orderBy(F.desc("datetime"))
    held = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") < LONGEST).drop("_rn")  # limited per task before the shuffle
    alarms = rows.where("alarm_active = 1").groupBy(key).agg(F.max("datetime").alias("last_alarm"))
    return held.select(key, "datetime", "alarm_active", *[c for c in ROLLING_COLS if c in hourly.columns]).join(alarms, key, "left")


def feature_stream(hourly: DataFrame, initial: DataFrame | None = None, ttl_hours: float | None = None, key: str = "inverter_id") -> DataFrame:
    """WN1-WN4 on a stream of hourly rows that come in time order per inverter (as ``hourly_stream`` gives them out).

    Adds the rolling columns, ``alarm_active``, ``alarm_count_24h``, ``alarm_count_7d`` and ``hours_since_last_alarm``. A row that isn't later
    than the inverter's latest is left out. ``initial``: see ``history``. ``ttl_hours``: state of an inverter that gets no rows for so long is
    dropped (by the clock).
    """
    use_state_store(hourly.sparkSession)
    rows = _with_flag(hourly)
    signals = [c for c in ROLLING_COLS if c in hourly.columns]
    more = [f"{c}_{n}_{s}" for c in signals for n in WINDOWS for s in ("mean", "std")] + ["alarm_count_24h", "alarm_count_7d", "hours_since_last_alarm"]
    schema = StructType(rows.schema.fields + [StructField(c, DoubleType()) for c in more])
    frames = {name: (w, min_periods(w)) for name, w in WINDOWS.items()}
    ttl = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    start = None if initial is None else initial.select(key, "datetime", "alarm_active", "last_alarm", *signals).groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(_Features(signals, frames, ttl), schema, "Append", "ProcessingTime" if ttl else "None", start)


class _Labels(StatefulProcessor):
    """Per inverter: the rows that wait for their label and as many that have theirs, with what was given out."""

    COLUMNS = ("at", "shutdown", "degradation", "target_binary", "target_multiclass", "complete", "revision")

    def __init__(self, key: str, n: int, idle_ms: int):
        self.key, self.n, self.idle_ms = key, n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ", ".join(f"{c} long" for c in self.COLUMNS))
        self.trimmed = handle.getValueState("trimmed", "at long")

    def _give(self, key, rows: np.ndarray, incomplete: bool) -> Iterator[pd.DataFrame]:
        """Labels that are new or changed; ``rows`` by time, one a row of ``COLUMNS``. The state is cut to what can still change."""
        size = len(rows)
        ahead = np.minimum(np.arange(size) + self.n, size)
        run = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(rows[:, 1:3], axis=0)])
        shut, degraded = (run[ahead] - run[:-1]).T > 0
        label = np.stack([shut | degraded, np.where(shut, 2, degraded)], axis=1).astype(np.int64)
        full = np.arange(size) + self.n <= size
        changed = (rows[:, 6] == 0) | (rows[:, 3:5] != label).any(axis=1) | (full & (rows[:, 5] == 0))
        out = changed & (full | incomplete)
        rows[out, 3:5], rows[out, 5] = label[out], full[out]
        rows[out, 6] += 1
        if out.any():
            yield pd.DataFrame({self.key: key[0], "datetime": rows[out, 0].astype("datetime64[us]"), "target_binary": rows[out, 3].astype(np.int32),
                                "target_multiclass": rows[out, 4].astype(np.int32), "complete": rows[out, 5] == 1, "revision": rows[out, 6]})
        # late rows are taken in behind the first ``n`` rows kept, so all rows that they change are still there
        drop = max(0, int(full.sum()) - 2 * self.n)
        if drop:
            self.trimmed.update((int(rows[drop - 1, 0]),))
        self.rows.put([tuple(r) for r in rows[drop:].tolist()])

    def _held(self) -> np.ndarray:
        return np.array(list(self.rows.get()), np.int64).reshape(-1, len(self.COLUMNS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        fresh = np.zeros((len(new), len(self.COLUMNS)), np.int64)
        fresh[:, 0] = _micros(new["datetime"])
        fresh[:, 1:3] = new[["shutdown_event", "degradation_event"]].to_numpy(np.int64)
        held = self._held()
        if self.trimmed.exists():
            fresh = fresh[fresh[:, 0] > held[self.n - 1, 0]]
        known = {int(a): i for i, a in enumerate(held[:, 0])}
        add = {}
        for r in fresh:  # a row that comes again replaces the one of its time
            if int(r[0]) in known:
                held[known[int(r[0])], 1:3] = r[1:3]
            else:
                add[int(r[0])] = r
        every = np.concatenate([held, np.array(list(add.values()), np.int64).reshape(-1, len(self.COLUMNS))])
        if not len(every):
            return
        every = every[np.argsort(every[:, 0], kind="stable")]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(every[-1, 0]) // 1000 + self.idle_ms)
        yield from self._give(key, every, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if len(held):
            yield from self._give(key, held, True)

    def close(self) -> None:
        pass


LABEL_SCHEMA = "datetime timestamp_ntz, target_binary int, target_multiclass int, complete boolean, revision long"


def label_stream(rows: DataFrame, window_days: int = 7, watermark: str = "48 hours", idle_hours: float = 72, key: str = "inverter_id") -> DataFrame:
    """WN5 + FN12 on a stream of hourly rows with ``shutdown_event`` and ``degradation_event``.

    Gives out (inverter_id, datetime, target_binary, target_multiclass, complete, revision) in update mode: a label when the row's
    ``window_days`` x 24 rows ahead are there (itself included), again with the next revision when a late row changes it. When the watermark
    passes an inverter's last row by ``idle_hours``, its waiting rows get the label of the rows that they have, ``complete`` false. The last revision
    of each row equals the batch operator's. Rows later than the watermark are left out, as are rows further back than about two windows of rows;
    an inverter's state is three windows of rows at most.
    """
    use_state_store(rows.sparkSession)
    timed = rows.withColumn("_ts", F.col("datetime").cast("timestamp")).withWatermark("_ts", watermark)
    kind = rows.schema[key].dataType.simpleString()
    return (timed.select(key, "datetime", "_ts", "shutdown_event", "degradation_event").groupBy(key)
            .transformWithStateInPandas(_Labels(key, window_days * 24, int(idle_hours * 3_600_000)), f"{key} {kind}, {LABEL_SCHEMA}", "Update", "EventTime"))
