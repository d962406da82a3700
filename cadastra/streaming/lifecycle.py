"""The life cycle of listings as a stream: one small state a listing, events as output.

Checks may arrive in any order within the watermark's delay: each waits until the watermark has passed it,
and a timer at the earliest one's time folds all that the watermark has passed, in order. A call of the
state machine costs far more than a check, so listings are dealt to ``GROUPS`` groups that wait together and
share a timer a batch; each listing has its own state in its group's map.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cadastra.operators.lifecycle import CONFIRMATIONS, MOST_CHANGE
from cadastra.session import ship

EVENTS = "listing long, at timestamp, event string, price double"
STATE = "status string, failures int, price double, last string, day string"


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of listings that wait together.
GROUPS = 1024
_START = ("active", 0, None, None, None)


def folded(state: tuple, checks: Iterator[tuple]) -> tuple[tuple, list[tuple]]:
    """State and events after ``checks`` (at, outcome, price) in order."""
    status, failures, price, last, day = state
    out = []
    for at, outcome, given in checks:
        today, new = str(at.date()), None if pd.isna(given) else float(given)
        if outcome == "ok":
            failures = 0
            if status == "inactive":
                status = "active"
                out.append((at, "reactivated", new))
            if price is None:
                price = new
            elif new is not None and price > 0 and abs(new - price) >= 1:
                taken = abs(new - price) / price <= MOST_CHANGE
                out.append((at, "price_change" if taken else "price_unconfirmed", new))
                price = new if taken else price
        elif outcome == "gone":
            failures += not (last == "gone" and day == today)
            if status != "inactive" and failures >= CONFIRMATIONS:
                status = "inactive"
                out.append((at, "deactivated", new))
        last, day = outcome, today
    return (status, int(failures), price, last, day), out


def _events(listing: int, events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(listing, *e) for e in events], columns=["listing", "at", "event", "price"])


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["at", "seq"])
    after, out = folded(state.get if state.exists else _START, ((r.at, r.outcome, r.price) for r in rows.itertuples(index=False)))
    state.update(after)
    yield _events(key[0], out)


class Lifecycle(StatefulProcessor):
    """Checks of a group of listings wait until the watermark has passed them; then each listing's are folded in order of time and number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a row a batch that arrived; the state of a listing is met only when it has checks to fold
        self.waiting = handle.getListState("waiting", "listing array<long>, us array<long>, seq array<long>, outcome array<string>, price array<double>")
        self.known = handle.getMapState("known", "listing long", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            listing, us, seq, outcome = (batch[c].tolist() for c in ("listing", "us", "seq", "outcome"))
            self.waiting.appendList([(listing, us, seq, outcome, [None if pd.isna(p) else p for p in batch["price"].tolist()])])
            first = min(us) if first is None else min(first, *us)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        held = [check for r in self.waiting.get() for check in zip(*r, strict=True)] if self.waiting.exists() else []
        due, rest = sorted(c for c in held if c[1] < until), [c for c in held if c[1] >= until]
        if due:
            events = []
            for listing, own in groupby(due, itemgetter(0)):
                before = self.known.getValue((listing,))
                after, out = folded(_START if before is None else tuple(before), ((pd.Timestamp(us * 1000), outcome, price) for _, us, _, outcome, price in own))
                self.known.updateValue((listing,), after)
                events += [(listing, *e) for e in out]
            if rest:
                self.waiting.put([tuple(map(list, zip(*rest, strict=True)))])
                self.handle.registerTimer(min(us for _, us, *_ in rest) // 1000 + 1)
            else:
                self.waiting.clear()
            if events:
                yield pd.DataFrame(events, columns=["listing", "at", "event", "price"])

    def close(self) -> None:
        pass


def lifecycle_unordered(checks: DataFrame, delay: str) -> DataFrame:
    """Events of ``checks(listing, at, seq, outcome, price)`` that arrive in any order, up to ``delay`` late.

    A check that comes later than that is dropped by the watermark, and checks that no later time has followed
    still wait. The session's state store must be RocksDB (``STORE``).
    """
    ship(checks.sparkSession)
    rows = checks.withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return rows.withColumn("group", F.pmod(F.xxhash64("listing"), F.lit(GROUPS))).groupBy("group").transformWithStateInPandas(statefulProcessor=Lifecycle(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def lifecycle_events(checks: DataFrame) -> DataFrame:
    """Events of ``checks(listing, at, seq, outcome, price)``; each listing's checks must arrive in order."""
    return checks.groupBy("listing").applyInPandasWithState(_step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
