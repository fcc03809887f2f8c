"""Age tiers of a running log: every event's way from hot to warm to cold as event time passes, by timers over keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LEVELS = ("hot", "warm", "cold", "gone")


class _Ageing(StatefulProcessor):
    """Holds, for each boundary to come, the events of a key that change at it. A boundary is a midnight, so a state has one entry and one timer a day and level, however many events."""

    def __init__(self, keys: Sequence[str], event: str):
        self.keys, self.event = list(keys), event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due bigint, level int", "events array<bigint>, cold bigint, gone bigint")

    def _pass(self, events: list[int], level: int, dues: tuple[int, int, int, int], now: int) -> list[tuple]:
        """What events of one day have gone through by ``now`` from ``level`` on, ``dues`` being when the levels begin; their next change is put down."""
        out = []
        while level < len(LEVELS) and dues[level] <= now:
            out += [(e, LEVELS[level], dues[level]) for e in events]
            level += 1
        if level < len(LEVELS):
            place = (dues[level], level)
            there = self.waiting.getValue(place)
            self.waiting.updateValue(place, ([*(there[0] if there else []), *events], dues[2], dues[3]))
            self.handle.registerTimer(dues[level])
        return out

    def _frame(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=[self.event, "tier", "at"])
            for k, (name, value) in enumerate(zip(self.keys, key, strict=True)):
                out.insert(k, name, value)
            yield out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            out = [(int(e), LEVELS[0], int(at)) for e, at in zip(part[self.event], part["hot"], strict=True)]
            for dues, day in part.groupby(["warm", "cold", "gone"]):
                out += self._pass([int(e) for e in day[self.event]], 1, (0, *map(int, dues)), now)
            yield from self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        now = max(timerValues.getCurrentWatermarkInMs(), due)
        for level in (1, 2, 3):
            there = self.waiting.getValue((due, level))
            if there:
                events, cold, gone = there
                self.waiting.removeKey((due, level))
                dues = (0, due, cold, gone) if level == 1 else (0, 0, due, gone) if level == 2 else (0, 0, 0, due)
                out += self._pass(list(events), level, dues, now)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def tier_changes(events: DataFrame, keys: Sequence[str], event: str = "event_id", ts: str = "ts", delay: str = "1 day", hot: int = 2, warm: int = 14, cold: int = 60, salts: int = 16) -> DataFrame:
    """The changes of tier of a stream of events: keys, event, tier (hot, warm, cold, gone), at (when it begins).

    An event is hot from its time on, warm once it is more than ``hot`` days old, cold after ``warm`` and gone after ``cold``, days counted as
    age_tier counts them; so the tier at any time that the watermark has passed is that of the last change up to it, whatever
    the order of arrival. An event that comes late (within ``delay``) is told with all it has gone through. State is held for
    events that are still to change, so none is older than ``cold`` days and the delay. A key's events are dealt over ``salts``
    states by a hash, so that a hot key has many. Rows without a time or an id are dropped. Append mode, event time; the state store must be RocksDB's (see run_to_end).
    """
    begins = lambda days: F.unix_millis(F.date_add(F.to_date(ts), days).cast("timestamp"))
    timed = events.where(F.col(ts).isNotNull() & F.col(event).isNotNull()).withWatermark(ts, delay)
    rows = timed.select(*keys, F.pmod(F.xxhash64(event), F.lit(salts)).cast("int").alias("salt"), F.col(event).cast("long").alias(event), ts, F.unix_millis(F.col(ts)).alias("hot"), begins(hot + 1).alias("warm"), begins(warm + 1).alias("cold"), begins(cold + 1).alias("gone"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "salt int", f"{event} long", "tier string", "at long"])
    changed = rows.groupBy(*keys, "salt").transformWithStateInPandas(_Ageing([*keys, "salt"], event), schema, "Append", "EventTime")
    return changed.drop("salt").withColumn("at", F.timestamp_millis("at"))


def tiers_at(changes: DataFrame, now: str, keys: Sequence[str], event: str = "event_id") -> DataFrame:
    """keys, event and tier of what is not gone at ``now``, from the changes up to it."""
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("tier"))
    last = changes.where(F.col("at") <= F.lit(now).cast("timestamp")).groupBy(*keys, event).agg(F.max_by("tier", F.struct("at", level)).alias("tier"))
    return last.where("tier <> 'gone'")
