"""Keyed state of the streaming jobs, kept by the engine's own state store.

The store holds one small record per key and writes only the keys that a micro-batch changed; a restart or a repeated micro-batch
starts from the state that the last finished one left. What a call holds in memory is one key's rows of one micro-batch, so the size
of a micro-batch (``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of the source) bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues


def clocked(events: DataFrame, micros: str, lateness_seconds: int) -> DataFrame:
    """``events`` under a watermark that follows the newest instant less the lateness, to the microsecond.

    The engine counts watermarks in milliseconds, so the clock runs a thousand times as fast. The clock column goes again, which keeps
    late rows in the stream: the processors set them aside instead of losing them.
    """
    clock = events.withColumn("_clock", F.timestamp_millis(F.col(micros)))
    return clock.withWatermark("_clock", f"{lateness_seconds * 1000} seconds").drop("_clock")


def _gathered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = list(rows)
    return pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)


class Baseline(StatefulProcessor):
    """Running count, mean and sum of squared deviations of each key; rows come out with the moments that include them.

    A row older than the watermark is late: it comes out without moments and changes nothing.
    """

    def __init__(self, micros: str, tie: str, values: list[str]):
        self.micros, self.tie, self.values = micros, tie, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"mean_{v} double, m2_{v} double" for v in self.values)
        self.moments = handle.getValueState("moments", f"n double, {fields}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        frame = _gathered(rows)
        # Most keys have few rows in a micro-batch, so a call does one selection and one assembly of columns.
        late = (frame[self.micros] < mark).to_numpy() if mark > 0 else np.zeros(len(frame), dtype=bool)
        fresh = np.flatnonzero(~late)
        order = frame[[self.micros, self.tie]].iloc[fresh].sort_values([self.micros, self.tie]).index if len(fresh) > 1 else fresh
        frame = frame.take(np.r_[order, np.flatnonzero(late)].astype(np.intp))
        added = {"late": np.arange(len(frame)) >= len(fresh)}
        for name in ("n", *(f"{m}_{v}" for v in self.values for m in ("mean", "var"))):
            added[name] = np.full(len(frame), np.nan)
        if count := len(fresh):
            held = self.moments.get() or (0.0,) * (1 + 2 * len(self.values))
            n = held[0] + np.arange(1, count + 1)
            state = [float(n[-1])]
            for i, v in enumerate(self.values):
                mean, m2 = held[1 + 2 * i], held[2 + 2 * i]
                x = frame[v].to_numpy(dtype=np.float64)[:count]
                # Sums around a value near the mean keep their digits.
                centre = mean if held[0] else x[0]
                apart = np.cumsum(x - centre)
                square = m2 + np.cumsum((x - centre) ** 2)
                means, m2s = centre + apart / n, np.maximum(square - apart**2 / n, 0.0)
                added[f"mean_{v}"][:count], added[f"var_{v}"][:count] = means, m2s / np.maximum(n - 1, 1)
                state += [float(means[-1]), float(m2s[-1])]
            added["n"][:count] = n
            self.moments.update(tuple(state))
        yield pd.DataFrame({**{c: frame[c].array for c in frame.columns}, **added}, copy=False)

    def close(self) -> None:
        pass


class Rates(StatefulProcessor):
    """Exact number of a key's rows within the last ``seconds`` of each row, both ends included.

    The store holds one count per instant of the key, as far back as a row that is not late may look: of a micro-batch, only instants that a
    later one can still reach are written. A timer drops instants that nothing
    can look back to any more, also for keys that have gone quiet. A late row (older than the watermark) comes out without a count and is
    in no other row's count. A row counts what has arrived with it or before it.
    """

    def __init__(self, micros: str, seconds: int, lateness_seconds: int = 0):
        self.micros, self.span, self.lateness = micros, seconds * 1_000_000, lateness_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.instants = handle.getMapState("instants", "at bigint", "calls bigint")

    def _expire(self, mark: int) -> list[tuple[int, int]]:
        """What is still within reach of a row at ``mark``; the rest goes."""
        held = []
        if self.instants.exists():
            for (at,), (calls,) in list(self.instants.iterator()):
                if mark > 0 and at < mark - self.span:
                    self.instants.removeKey((at,))
                else:
                    held.append((at, calls))
        return held

    def _wake(self, earliest: int) -> None:
        """A timer for the moment when the earliest instant is out of reach."""
        self.handle.registerTimer(earliest + self.span + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        frame = _gathered(rows)
        frame["late"] = frame[self.micros] < mark if mark > 0 else False
        frame["calls"] = pd.array([None] * len(frame), dtype="Int64")
        fresh = ~frame["late"].to_numpy()
        if fresh.any():
            own = frame[self.micros].to_numpy(dtype=np.int64)[fresh]
            held = self._expire(mark)
            at, calls = np.array([*(h[0] for h in held), *own], dtype=np.int64), np.array([*(h[1] for h in held), *np.ones(len(own), np.int64)], dtype=np.int64)
            instants, which = np.unique(at, return_inverse=True)
            counts = np.bincount(which, weights=calls).astype(np.int64)
            until = np.r_[0, np.cumsum(counts)]
            seen = until[np.searchsorted(instants, own, side="right")] - until[np.searchsorted(instants, own - self.span, side="left")]
            frame.loc[fresh, "calls"] = seen
            changed = np.isin(instants, own)
            # The next watermark is at least the newest of these rows less the lateness.
            ahead = max(mark, int(instants[-1]) - self.lateness)
            if ahead > 0:
                changed &= instants >= ahead - self.span
            for instant, count in zip(instants[changed].tolist(), counts[changed].tolist()):
                self.instants.updateValue((instant,), (count,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self._wake(int(instants[0]))
        yield frame

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._expire(timerValues.getCurrentWatermarkInMs())
        if held:
            self._wake(min(at for at, _ in held))
        return iter(())

    def close(self) -> None:
        pass


class Expiring(StatefulProcessor):
    """What was last said about a key, as long as it is no older than ``seconds``, for each row that asks.

    Rows with a ``payload`` say something about the key at their instant; the others ask, and come out with the payload of the newest
    such row at or before their own instant that is at most ``seconds`` old (null: none; of equal instants the greatest payload). The store holds what a row
    that is not late can still be answered with; a timer drops the rest, also for keys that have gone quiet. A late row that asks comes
    out without an answer; a late payload counts as long as it is in reach.
    """

    def __init__(self, micros: str, payload: str, seconds: int):
        self.micros, self.payload, self.span = micros, payload, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getMapState("said", "at bigint", "payload string")

    def _kept(self, mark: int, fresh: dict[int, str]) -> dict[int, str]:
        """The payloads by instant that can still answer a row at ``mark`` or later; the store follows."""
        stored = {at: payload for (at,), (payload,) in self.said.iterator()} if self.said.exists() else {}
        held = dict(stored)
        for at, payload in fresh.items():
            held[at] = max(payload, held.get(at, payload))
        if mark > 0:
            passed = max((at for at in held if at <= mark), default=mark)
            held = {at: payload for at, payload in held.items() if at >= max(passed, mark - self.span) or at > mark}
        for at in stored.keys() - held.keys():
            self.said.removeKey((at,))
        for at, payload in held.items():
            if stored.get(at) != payload:
                self.said.updateValue((at,), (payload,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(min(held) + self.span + 1)
        return held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        frame = _gathered(rows)
        says = frame[self.payload].notna()
        fresh: dict[int, str] = {}
        for at, payload in zip(frame.loc[says, self.micros].tolist(), frame.loc[says, self.payload].tolist()):
            fresh[at] = max(payload, fresh.get(at, payload))
        held = self._kept(mark, fresh)
        asked = frame[~says].reset_index(drop=True)
        asked["late"] = asked[self.micros] < mark if mark > 0 else False
        at = np.array(sorted(held), dtype=np.int64)
        own = asked[self.micros].to_numpy(dtype=np.int64)
        place = np.searchsorted(at, own, side="right") - 1
        asked[self.payload] = [
            held[int(at[i])] if i >= 0 and not late and when - at[i] <= self.span else None for i, when, late in zip(place, own, asked["late"])
        ]
        yield asked

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._kept(timerValues.getCurrentWatermarkInMs(), {})
        return iter(())

    def close(self) -> None:
        pass


def schema_with(events: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields), added])
