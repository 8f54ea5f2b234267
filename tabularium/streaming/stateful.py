"""Stateful processors of the streams: typed list and value state, timers and time to live, kept by the RocksDB provider.

A group's rows come in frames of bounded size, in no order. Uploads and sessions are folded frame by frame; the limiter holds
16 bytes for every row that a key has in the batch, as it must decide them in the order of time. Uploads and sessions
group many keys by a hash, so a call, a timer and a state access serve all keys of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tabularium.operators.limiter import allow

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FRAME_ROWS = 10_000  # of an output frame
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

UPLOAD, FINISHED = ["name", "at", "event_id", "status", "uploaded_bytes", "total_bytes"], ("completed", "failed")
SESSION = ["name", "first", "last", "events"]


def with_rocks_db(stream: DataFrame) -> DataFrame:
    """The stream, its session set to keep streaming state in RocksDB as ``transformWithState`` needs."""
    stream.sparkSession.conf.set(PROVIDER, ROCKS_DB)
    return stream


def _repeated(value, times: int) -> pd.Series:
    """A key as a column of plain objects, whatever string type pandas would choose."""
    return pd.Series([value] * times, dtype=object)


def _objects(values: Iterable) -> pd.Series:
    return pd.Series(list(values), dtype=object)


def _text(value) -> str | None:
    """A text of a frame; a missing one is None, whatever pandas holds there."""
    return value if isinstance(value, str) else None


class RequestLimiter(StatefulProcessor):
    """A decision for every request in the order of arrival.

    Requests that are not older than the newest one decided are judged like the batch operator does. An older one is ``late``: if it
    is within ``lateness`` of the newest, it is judged by the allowed requests of the window before it, which are
    still remembered; beyond that it is denied. State: the allowed times of window and lateness, and the newest time; with
    ``idle_ms`` both have a time to live, which needs the processing-time mode.
    """

    def __init__(self, key: str, limit: int, window: int, lateness: int, idle_ms: int | None) -> None:
        self.key, self.limit, self.window, self.lateness, self.idle_ms = key, limit, window, lateness, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.allowed = handle.getListState("allowed", "at long", self.idle_ms)
        self.newest = handle.getValueState("newest", "at long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(row[0] for row in self.allowed.get())
        newest = self.newest.get()[0] if self.newest.exists() else None
        # Frames come in no order of time, so the times and ids of the batch are put in order before any is decided.
        frames = [(frame["at"].to_numpy(np.int64), frame["event_id"].to_numpy()) for frame in rows]
        at, ids = (np.concatenate(part) for part in zip(*frames))
        del frames
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        late = np.zeros(len(at), bool) if newest is None else at < newest
        verdict = np.zeros(len(at), bool)
        for place in np.flatnonzero(late):
            now = int(at[place])
            inside = sum(now - self.window < t <= now for t in times)
            verdict[place] = now >= newest - self.lateness and inside < self.limit
            if verdict[place]:
                times = sorted([*times, now])
        on_time = at[~late]
        if len(on_time):
            last = int(on_time[0])
            remembered = tuple(t for t in times if last - t < self.window)[-self.limit :]
            verdict[~late], _ = allow(on_time, remembered, self.limit, self.window)
            newest = int(on_time[-1])
            times = [t for t in [*times, *on_time[verdict[~late]].tolist()] if newest - t < self.window + self.lateness]
        for start in range(0, len(at), FRAME_ROWS):
            some = slice(start, start + FRAME_ROWS)
            yield pd.DataFrame({self.key: _repeated(key[0], len(at[some])), "event_id": ids[some], "allowed": verdict[some], "late": late[some]})
        self.allowed.put([(int(t),) for t in times])
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


class LatestUpload(StatefulProcessor):
    """The newest status of every resource of a group; a finished one is forgotten ``keep_ms`` after its last event.

    State: a row for each resource. One timer stands for the first resource to be forgotten.
    """

    def __init__(self, key: str, keep_ms: int) -> None:
        self.key, self.keep_ms = key, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", "name string, at long, event_id long, status string, uploaded double, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = {row[0]: tuple(row[1:]) for row in self.best.get()}
        seen = set()
        for frame in rows:
            newest = frame.sort_values(["at", "event_id"], kind="stable").drop_duplicates("name", keep="last")
            for name, at, event_id, status, uploaded, total in zip(*(newest[c].tolist() for c in UPLOAD)):
                name, status = _text(name), _text(status)
                seen.add(name)
                if name not in best or best[name][:2] <= (at, event_id):
                    best[name] = at, event_id, status, float(uploaded), float(total)
        self._keep(best, timerValues)
        found = [(name, *best[name]) for name in seen]
        share = [min(100.0, uploaded / total * 100.0) if total else 0.0 for *_, uploaded, total in found]
        yield pd.DataFrame({
            self.key: _objects(f[0] for f in found), "event_id": [f[2] for f in found], "ts": pd.to_datetime([f[1] for f in found], unit="us"),
            "status": _objects(f[3] for f in found), "percent": share, "finished": [f[3] in FINISHED for f in found]})

    def _keep(self, best: dict[str | None, tuple], timerValues) -> None:
        self.best.put([(name, *state) for name, state in best.items()])
        ends = [state[0] // 1000 + self.keep_ms for state in best.values() if state[2] in FINISHED]
        if ends:
            self.handle.registerTimer(max(min(ends), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        best = {row[0]: tuple(row[1:]) for row in self.best.get()}
        left = {name: state for name, state in best.items() if state[2] not in FINISHED or state[0] // 1000 + self.keep_ms > now}
        if left:
            self._keep(left, timerValues)
        else:
            self.best.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Sessions of the keys of a group, open ones included: a row whenever one grows, and one when it closes.

    State: the open sessions as (key, first, last, events) in microseconds. A row within the gap of two sessions joins them;
    the session that is taken in gets a row with no events. A session closes when the watermark passes its end; one timer
    stands for the first to close.
    """

    def __init__(self, key: str, gap: int) -> None:
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("sessions", "name string, first long, last long, events long")

    def _rows(self, sessions: list[tuple[str | None, int, int, int, bool]]) -> pd.DataFrame:
        name, first, last, events, still = zip(*sessions) if sessions else ((), (), (), (), ())
        as_time = lambda values: pd.to_datetime(np.array(values, np.int64), unit="us")
        return pd.DataFrame({self.key: _objects(name), "session_start": as_time(first), "session_end": as_time(last), "events": list(events), "open": list(still)})

    def _keep(self, sessions: list[tuple[str | None, int, int, int]], timerValues) -> None:
        if sessions:
            self.held.put(sessions)
            end = (min(s[2] for s in sessions) + self.gap) // 1000 + 1
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {tuple(s) for s in self.held.get()}
        merged = pd.DataFrame(sorted(before, key=lambda s: s[1]), columns=SESSION)
        waiting: list[pd.DataFrame] = []
        for frame in rows:
            waiting.append(pd.DataFrame({"name": frame["name"].astype(object), "first": frame["at"], "last": frame["at"], "events": 1}))
            if sum(map(len, waiting)) > max(len(merged), FRAME_ROWS):  # so that a session is merged a few times only
                merged, waiting = self._merged([merged, *waiting]), []
        merged = self._merged([merged, *waiting])
        sessions = list(zip(map(_text, merged["name"]), *(merged[c].tolist() for c in SESSION[1:])))
        self._keep(sessions, timerValues)
        grown = [s for s in sessions if s not in before]
        gone = {s[:2] for s in before} - {s[:2] for s in sessions}
        yield self._rows([(*s, True) for s in grown] + [(name, first, first, 0, False) for name, first in gone])

    def _merged(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """Sessions, in any order, with those of a key that lie within the gap of each other made one."""
        parts = [p for p in parts if len(p)]
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        rows = rows.assign(code=pd.factorize(rows["name"], use_na_sentinel=False)[0]).sort_values(["code", "first"], ignore_index=True)
        code, end = rows["code"].to_numpy(), rows.groupby("code")["last"].cummax().to_numpy()
        opens = np.r_[True, (code[1:] != code[:-1]) | (rows["first"].to_numpy(np.int64)[1:] - end[:-1] >= self.gap)]
        start = np.flatnonzero(opens)
        return pd.DataFrame({
            "name": rows["name"].to_numpy(object)[start], "first": rows["first"].to_numpy(np.int64)[start],
            "last": np.maximum.reduceat(rows["last"].to_numpy(np.int64), start), "events": np.add.reduceat(rows["events"].to_numpy(np.int64), start)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = [tuple(s) for s in self.held.get()]
        self._keep([s for s in sessions if s[2] + self.gap > now], timerValues)
        yield self._rows([(*s, False) for s in sessions if s[2] + self.gap <= now])

    def close(self) -> None:
        pass
