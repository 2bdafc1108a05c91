"""Event-time processors, batch by batch without a stream: arrival in any order inside the watermark gives what sorted rows give."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tramline.streaming import ordered

DELAY = 15


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Driver:
    """Feeds one key's micro-batches to a processor, as the engine would: rows first, then the timers that the watermark has reached."""

    def __init__(self, processor, key=("k",)):
        self.state, self.timers, self.mark, self.most, self.out, self.key = Held(), set(), 0, 0, [], key
        processor.init(SimpleNamespace(getValueState=lambda name, kind: self.state, registerTimer=self.timers.add, deleteTimer=self.timers.discard))
        self.processor = processor

    def batch(self, frame=None, clock=None):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: self.mark)
        if frame is not None and len(frame):
            self.out += self.processor.handleInputRows(self.key, iter([frame]), now)
            self.most = max(self.most, int(frame["epoch_s"].max()))
        for t in sorted(x for x in self.timers if x <= self.mark):
            if t in self.timers:
                self.timers.discard(t)
                self.out += self.processor.handleExpiredTimer(self.key, now, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
        self.most = max(self.most, clock or 0)
        self.mark = max(self.mark, (self.most - DELAY) * 1000)

    def rows(self):
        return pd.concat(self.out, ignore_index=True) if self.out else pd.DataFrame()


def arrivals(rng, times, batches=6):
    """Micro-batches in which every row comes at most ten seconds after its time."""
    come = sorted((t + rng.randrange(11), k, t) for k, t in enumerate(times))
    cuts = sorted(rng.sample(range(len(come) + 1), batches - 1))
    return [[t for _, _, t in come[a:b]] for a, b in zip([0, *cuts], [*cuts, len(come)], strict=True)]


def seen(times):
    return pd.DataFrame({"epoch_s": np.array(times, np.int64)})


def key(route="7", direction=0):
    return (f'{{"route_id":"{route}","direction_id":{direction}}}',)


@pytest.mark.parametrize("seed", range(30))
def test_gaps_do_not_depend_on_arrival(seed):
    rng = random.Random(seed)
    times, t = [], 1000
    for _ in range(80):
        t += rng.choice([1, 2, 20, 59, 60, 61, 200])
        times.append(t)
    drive = Driver(ordered.GapWatch(60), key())
    for some in arrivals(rng, times):
        drive.batch(seen(rng.sample(some, len(some))))
    for _ in range(3):
        drive.batch(clock=t + 1000)
    rows = drive.rows()
    when = lambda c, df: [int(x.timestamp()) for x in df[c]]
    closed = rows[rows["status"] == "closed"]
    assert [*zip(when("gap_start", closed), when("gap_end", closed), strict=True)] == [(a, b) for a, b in zip(times, times[1:], strict=False) if b - a > 60]
    opened = rows[rows["status"] == "open"]
    assert when("gap_start", opened)[-1] == t and opened["gap_end"].isna().all()
    assert len(set(when("gap_start", opened))) == len(opened), "a gap is told as open once"


def test_a_route_that_never_returns_raises_one_alarm_and_is_forgotten():
    drive = Driver(ordered.GapWatch(60, forget_s=500), key("9", 1))
    drive.batch(seen([1000, 1010]))
    drive.batch(clock=1010 + 60 + DELAY - 1)
    drive.batch(clock=1010 + 60 + DELAY)
    assert not len(drive.rows())
    drive.batch()
    row = drive.rows().iloc[0]
    assert len(drive.rows()) == 1 and (row["route_id"], row["direction_id"], row["status"]) == ("9", 1, "open") and row["gap_start"].timestamp() == 1010
    drive.batch(clock=1010 + 400)
    drive.batch(seen([1005, 1010]))  # late: neither closes the gap nor wakes it
    assert len(drive.rows()) == 1 and drive.state.exists()
    drive.batch(clock=1010 + 500 + DELAY)
    drive.batch()
    assert not drive.state.exists() and not drive.timers


def test_an_open_gap_is_closed_by_the_return():
    drive = Driver(ordered.GapWatch(60), key())
    drive.batch(seen([1000]))
    drive.batch(clock=1200)
    drive.batch()
    drive.batch(seen([1300]))
    drive.batch(clock=1400)
    drive.batch()
    got = [(r.status, int(r.gap_start.timestamp()), None if pd.isna(r.gap_duration_sec) else r.gap_duration_sec) for r in drive.rows().itertuples()]
    assert got == [("open", 1000, None), ("closed", 1000, 300.0), ("open", 1300, None)]
    assert drive.state.value[0] == [1300], "one run of state"


def fixes(times, ids=None):
    return pd.DataFrame({
        "vehicle_id": "v", "route_id": "r", "direction_id": [None if t % 7 == 0 else 1 for t in times], "latitude": [44.4 + (t % 50) / 1e4 for t in times], "longitude": 26.1,
        "epoch_s": times, "event_id": ids or times, "event_time": pd.to_datetime(times, unit="s"),
    })


@pytest.mark.parametrize("seed", range(30))
def test_segments_do_not_depend_on_arrival(seed):
    rng = random.Random(seed)
    times, t = [], 1000
    for _ in range(60):
        t += rng.choice([3, 6, 10, 30, 200, 299, 300, 400])
        times.append(t)
    drive = Driver(ordered.OrderedFixes(), ("v",))
    for some in arrivals(rng, times):
        drive.batch(fixes(rng.sample(some * 2, 2 * len(some))) if some else None)  # repeated rows change nothing
    for _ in range(3):
        drive.batch(clock=t + 1000)
    plain = fixes(times).assign(event_time=lambda d: d["event_time"].astype("datetime64[us]").astype("int64"))
    want = ordered.segment_rows("v", None, plain)
    got = drive.rows()
    assert len(want) > 10 and got["event_time"].tolist() == want["event_time"].tolist()
    assert np.allclose(got["speed_kmh"], want["speed_kmh"]) and got["direction_id"].isna().tolist() == want["direction_id"].isna().tolist()
    assert not drive.state.exists() and not drive.timers, "nothing is kept once no link is possible"


def test_late_fixes_neither_link_nor_move_the_state():
    drive = Driver(ordered.OrderedFixes(), ("v",))
    for times in ([101, 205], [213], [150], [264]):
        drive.batch(fixes(times))
    drive.batch(clock=400)
    drive.batch()
    assert [int(x.timestamp()) for x in drive.rows()["event_time"]] == [205, 213, 264]


def test_a_bucket_holds_many_vehicles_and_routes():
    """One call and one state serve all that are in a bucket, and each gets the rows that it would have alone."""
    rng = random.Random(7)
    times = {k: sorted(rng.sample(range(1000, 6000), 60)) for k in "abc"}
    want_gaps, want_speeds, bucket, watch = [], [], Driver(ordered.OrderedFixes(), (5,)), Driver(ordered.GapWatch(60), (5,))
    for k, own in times.items():
        plain = fixes(own).assign(event_time=lambda d: d["event_time"].astype("datetime64[us]").astype("int64"))
        want_speeds += [(k, t) for t in ordered.segment_rows(k, None, plain)["event_time"]]
        want_gaps += [(k, a, b) for a, b in zip(own, own[1:], strict=False) if b - a > 60]
    for lo in range(1000, 6000, 700):
        some = [(k, t) for k, own in times.items() for t in own if lo <= t < lo + 700]
        rng.shuffle(some)
        who, at = [k for k, _ in some], [t for _, t in some]
        bucket.batch(fixes(at).assign(vehicle_id=who))
        watch.batch(seen(at).assign(key=[key(k)[0] for k in who]))
    for drive in (bucket, watch):
        for _ in range(3):
            drive.batch(clock=9000)
    closed = watch.rows().query("status == 'closed'")
    assert sorted((r.route_id, int(r.gap_start.timestamp()), int(r.gap_end.timestamp())) for r in closed.itertuples()) == sorted(want_gaps)
    assert sorted((r.vehicle_id, r.event_time) for r in bucket.rows().itertuples()) == sorted(want_speeds) and len(want_speeds) > 60
