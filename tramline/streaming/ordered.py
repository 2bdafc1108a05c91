"""Stateful stream operators that follow event time: what arrives out of order waits in state until the watermark has passed it.

Both are processors of ``transformWithStateInPandas``.  Vehicles and route directions are dealt over a fixed number of buckets by hash, and
a bucket is a key of the stream: a batch of one bucket reads and writes its state once and handles all that are in it as arrays, so that
calls and state accesses do not grow with their number.  An event-time timer wakes the bucket when the watermark reaches what the first in it
waits for, so results do not depend on whether a further row ever comes.

Rows at or behind the watermark are late and left out; repeated rows change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tramline.config import DEFAULT, TransitConfig

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RD = ("route_id", "direction_id")
ALARMS = "gap_start timestamp, gap_end timestamp, route_id string, direction_id int, gap_duration_sec double, status string"
SEGMENT = "vehicle_id string, route_id string, direction_id int, event_time timestamp, speed_kmh double"
FORGET_S = 7 * 86400
BUCKETS = 1024  # a stream's checkpoint is bound to their number, as it is to that of its partitions
LINK_S = (5, 300)  # fixed values: seconds between linked fixes, both ends excluded
TOP_KMH = 120


def _state_store(spark: SparkSession) -> None:
    """Timers need the RocksDB state store, unless the session names one of its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKS)


class _Waking(StatefulProcessor):
    """A processor whose buckets have one timer each, in milliseconds of event time; 0 stands for none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.STATE)

    def wake(self, old: int, new: int) -> int:
        if old != new:
            if old:
                self.handle.deleteTimer(old)
            if new:
                self.handle.registerTimer(new)
        return new

    def close(self) -> None:
        pass


def _same(codes: np.ndarray) -> np.ndarray:
    """Whether each but the last of grouped rows is followed by one of its own group."""
    return codes[1:] == codes[:-1]


def merge_runs(runs: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """``who, lo, hi, told`` as runs of sightings none of which is further than ``threshold`` from the next, grouped and in order."""
    codes = pd.factorize(runs["who"])[0].astype(np.int64)
    lo, hi = runs["lo"].to_numpy(np.int64), runs["hi"].to_numpy(np.int64)
    order = np.lexsort((hi, lo, codes))
    base, width = lo.min(), hi.max() - lo.min() + threshold + 1
    apart = codes[order] * width  # so that one running maximum serves all: no group reaches into the next
    starts, ends = lo[order] - base + apart, np.maximum.accumulate(hi[order] - base + apart)
    cut = np.nonzero(np.r_[True, starts[1:] - ends[:-1] > threshold] | np.r_[True, ~_same(codes[order])])[0]
    last = np.r_[cut[1:] - 1, len(order) - 1]
    told = np.logical_or.reduceat(runs["told"].to_numpy(bool)[order], cut)
    return pd.DataFrame({"who": runs["who"].to_numpy()[order][cut], "lo": lo[order][cut], "hi": ends[last] - apart[last] + base, "told": told})


class GapWatch(_Waking):
    """Gaps between the sightings of route directions, each named by ``key`` in its rows (or by the key of the stream).

    The state is, for each, the list of runs of sightings that are closer together than the threshold, the first of which is final but for
    its end; in a live stream that is one run, or two around a gap.  The gap between two runs is final, and told as closed,
    once the watermark has reached the later one.  A last run is told as an open gap once the watermark is a threshold beyond its end.
    """

    STATE = "lo array<bigint>, hi array<bigint>, who array<string>, told array<boolean>, timer bigint"

    def __init__(self, threshold_s: int, forget_s: int = FORGET_S):
        self.threshold, self.forget = threshold_s, max(forget_s, threshold_s + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        runs, timer = self._load()
        runs, out = self._settled(runs, mark)  # what the watermark said before these rows came
        fresh = pd.concat([*rows], ignore_index=True)
        seen = fresh["epoch_s"].to_numpy(np.int64)
        new = pd.DataFrame({"who": fresh["key"] if "key" in fresh else key[0], "lo": seen, "hi": seen, "told": False})[seen * 1000 > mark]
        if len(new):
            runs, more = self._settled(merge_runs(pd.concat([runs, new]) if len(runs) else new, self.threshold), mark)
            out += more
        yield from self._store(runs, timer, mark, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        runs, timer = self._load()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            timer = 0  # it has fired
        runs, out = self._settled(runs, mark)
        yield from self._store(runs, timer, mark, out)

    def _load(self) -> tuple[pd.DataFrame, int]:
        lo, hi, who, told, timer = self.held.get() if self.held.exists() else ([], [], [], [], 0)
        return pd.DataFrame({"who": np.array(list(who), object), "lo": np.array(list(lo), np.int64), "hi": np.array(list(hi), np.int64), "told": np.array(list(told), bool)}), timer

    def _settled(self, runs: pd.DataFrame, mark: int) -> tuple[pd.DataFrame, list[tuple]]:
        """The runs without those whose gap is final, and what is told: ``(who, hi, lo of the next or None)``; the last of each may be open."""
        if not len(runs):
            return runs, []
        who, lo, hi = (runs[c].to_numpy() for c in ("who", "lo", "hi"))
        closed = np.r_[_same(who) & (lo[1:] * 1000 <= mark), False]
        at = np.nonzero(closed)[0]
        out = [*zip(who[at], hi[at].tolist(), lo[at + 1].tolist(), strict=True)]
        runs = runs[~closed].reset_index(drop=True)
        who, hi, told = runs["who"].to_numpy(), runs["hi"].to_numpy(), runs["told"].to_numpy(bool).copy()
        opened = self._alone(who) & ~told & ((hi + self.threshold) * 1000 <= mark)
        told[opened] = True
        return runs.assign(told=told), out + [(w, x, None) for w, x in zip(who[opened], hi[opened].tolist(), strict=True)]

    @staticmethod
    def _alone(who: np.ndarray) -> np.ndarray:
        same = _same(who)
        return ~(np.r_[False, same] | np.r_[same, False])

    def _store(self, runs: pd.DataFrame, timer: int, mark: int, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if len(runs):
            gone = self._alone(runs["who"].to_numpy()) & runs["told"].to_numpy(bool) & ((runs["hi"].to_numpy() + self.forget) * 1000 <= mark)
            runs = runs[~gone]
        if not len(runs):
            self.wake(timer, 0)
            self.held.clear()
        else:
            who, lo, hi, told = (runs[c].to_numpy() for c in ("who", "lo", "hi", "told"))
            alone, same = self._alone(who), np.r_[False, _same(who)]
            wait = min([*(hi + np.where(told, self.forget, self.threshold))[alone].tolist(), *lo[same].tolist()])
            self.held.update((lo.tolist(), hi.tolist(), who.tolist(), told.tolist(), self.wake(timer, wait * 1000)))
        if out:
            named = {w: json.loads(w) for w in {x[0] for x in out}}
            a, b = [x[1] for x in out], [x[2] for x in out]
            yield pd.DataFrame({
                "gap_start": pd.to_datetime(a, unit="s"), "gap_end": pd.to_datetime(pd.array(b, "Int64"), unit="s"), "route_id": [named[x[0]].get("route_id") for x in out],
                "direction_id": pd.array([named[x[0]].get("direction_id") for x in out], "Int32"), "gap_duration_sec": [None if y is None else float(y - x) for x, y in zip(a, b, strict=True)],
                "status": ["open" if y is None else "closed" for y in b],
            })


def _bucket(name: str, buckets: int):
    return F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket")


def gap_alarms(df: DataFrame, cfg: TransitConfig = DEFAULT, forget_s: int = FORGET_S, buckets: int = BUCKETS) -> DataFrame:
    """Gaps of each route direction: ``open`` when it has been silent for the threshold, ``closed`` when the sighting that ends the gap is final.

    A direction that never returns leaves its open row; after ``forget_s`` its state is dropped, and a later return starts anew.
    """
    _state_store(df.sparkSession)
    # One text as the name: nulls are part of it.
    marked = df.withWatermark("event_time", f"{cfg.watermark_s} seconds").select(F.to_json(F.struct(*RD)).alias("key"), "epoch_s", "event_time")
    return marked.select(_bucket("key", buckets), "*").groupBy("bucket").transformWithStateInPandas(GapWatch(cfg.service_gap_s, forget_s), ALARMS, "append", "EventTime")


class OrderedFixes(_Waking):
    """Speeds between vehicles' consecutive fixes in order of time.

    The state is, for each vehicle, the last fix that is final and those behind the watermark's reach, which wait.  When the watermark passes
    fixes they are linked in order.  A vehicle whose last fix is too old to be linked and of which nothing waits is dropped.
    """

    WAITING = ("vehicle_id", "event_id", "epoch_s", "event_time", "latitude", "longitude", "route_id", "direction_id")
    LAST = ("vehicle_id", "latitude", "longitude", "epoch_s")
    STATE = (
        "last_who array<string>, last_lat array<double>, last_lon array<double>, last_t array<bigint>, who array<string>, ids array<bigint>, t array<bigint>, at array<bigint>, "
        "lat array<double>, lon array<double>, route array<string>, direction array<int>, timer bigint"
    )

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, waiting, timer = self._load()
        fresh = pd.concat([*rows], ignore_index=True)
        fresh["event_time"] = fresh["event_time"].astype("datetime64[us]").astype("int64")
        mark = timerValues.getCurrentWatermarkInMs()
        fresh = self._typed(fresh[fresh["event_time"] // 1000 > mark])
        yield from self._release(last, pd.concat([waiting, fresh], ignore_index=True) if len(waiting) else fresh, timer, mark)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, waiting, timer = self._load()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            timer = 0
        yield from self._release(last, waiting, timer, timerValues.getCurrentWatermarkInMs())

    def _typed(self, rows: pd.DataFrame) -> pd.DataFrame:
        kinds = {"event_id": "int64", "epoch_s": "int64", "event_time": "int64", "latitude": "float64", "longitude": "float64", "direction_id": "float64"}
        return rows[list(self.WAITING)].astype(kinds)

    def _load(self) -> tuple[pd.DataFrame, pd.DataFrame, int]:
        held = [list(x) if k < 12 else x for k, x in enumerate(self.held.get())] if self.held.exists() else [*([] for _ in range(12)), 0]
        last = pd.DataFrame(dict(zip(self.LAST, held[:4], strict=True))).astype({"latitude": "float64", "longitude": "float64", "epoch_s": "int64"})
        return last, self._typed(pd.DataFrame(dict(zip(self.WAITING, held[4:12], strict=True)))), held[12]

    def _release(self, last: pd.DataFrame, waiting: pd.DataFrame, timer: int, mark: int) -> Iterator[pd.DataFrame]:
        by = ["vehicle_id", "epoch_s", "event_id"]
        waiting = waiting.drop_duplicates(by).sort_values(by, ignore_index=True)
        final = (waiting["event_time"] // 1000 <= mark).to_numpy()
        done, rest = waiting[final], waiting[~final]
        linked = segment_rows(done["vehicle_id"], last, done) if len(done) else None
        if linked is not None:
            last = pd.concat([last, done[list(self.LAST)]] if len(last) else [done[list(self.LAST)]]).drop_duplicates("vehicle_id", keep="last")
        quiet = ~last["vehicle_id"].isin(rest["vehicle_id"]).to_numpy()  # of these only the last fix is held
        until = (last["epoch_s"].to_numpy() + LINK_S[1]) * 1000
        keep = ~quiet | (until > mark)
        waits = [*until[quiet & keep].tolist(), *(-(-rest["event_time"].to_numpy() // 1000)).tolist()]
        if not waits:
            self.wake(timer, 0)
            self.held.clear()
        else:
            held = [last[keep][c].tolist() for c in self.LAST] + [rest[c].tolist() for c in self.WAITING]
            held[-1] = [None if v != v else int(v) for v in held[-1]]
            self.held.update((*held, self.wake(timer, int(min(waits)))))
        if linked is not None and len(linked):
            yield linked


def segment_rows(vehicle: str | pd.Series, last: pd.DataFrame | None, fixes: pd.DataFrame) -> pd.DataFrame:
    """Valid segments that end at each of ``fixes``, which are in order by vehicle; ``last`` has the fixes before them, one for a vehicle."""
    rows = fixes.assign(vehicle_id=vehicle)
    if last is not None and len(last):
        rows = pd.concat([last, rows], ignore_index=True)  # without further columns: they are not told
    codes = pd.factorize(rows["vehicle_id"])[0]
    rows = rows.iloc[np.argsort(codes, kind="stable")]
    codes = np.sort(codes, kind="stable")
    lat, lon, t = (rows[c].to_numpy(float) for c in ("latitude", "longitude", "epoch_s"))
    dt = np.diff(t)
    dy, dx = np.diff(lat) * 111.32, np.diff(lon) * 111.32 * np.cos(np.radians(lat[:-1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        speed = np.sqrt(dx * dx + dy * dy) / (dt / 3600.0)
    ok = _same(codes) & (dt > LINK_S[0]) & (dt < LINK_S[1]) & (speed > 0) & (speed < TOP_KMH)
    rows = rows.iloc[1:][ok]
    direction = pd.array(rows["direction_id"].astype("float64"), "Int32")
    out = pd.DataFrame({"vehicle_id": rows["vehicle_id"].to_numpy(), "route_id": rows["route_id"].to_numpy(), "direction_id": direction, "event_time": pd.to_datetime(rows["event_time"].to_numpy("int64"), unit="us")})
    out["speed_kmh"] = speed[ok]
    return out


def segments(df: DataFrame, cfg: TransitConfig = DEFAULT, buckets: int = BUCKETS) -> DataFrame:
    """Valid speed segments of a stream, in the order of the fixes' own times; fixes may arrive in any order inside the watermark."""
    _state_store(df.sparkSession)
    need = df if "event_id" in df.columns else df.withColumn("event_id", F.lit(0).cast("long"))
    marked = need.filter("vehicle_id is not null").withWatermark("event_time", f"{cfg.watermark_s} seconds").select(_bucket("vehicle_id", buckets), *OrderedFixes.WAITING)
    return marked.groupBy("bucket").transformWithStateInPandas(OrderedFixes(), SEGMENT, "append", "EventTime")
