"""Listing life cycle: the fold of a listing's checks into events, in batch; see ``streaming`` for the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRMATIONS, MOST_CHANGE = 3, 0.6
EVENT = "struct<at:timestamp,event:string,price:double>"


def step(state: Column, check: Column) -> Column:
    """One check folded into a state.

    ``gone`` on three days deactivates; a second ``gone`` of a day right after a gone doesn't count.
    Blocked and error change nothing but what the last outcome was. ``ok`` resets and reactivates, and
    takes a price that differs by 60 % at most.
    """
    day = F.to_date(check["at"])
    ok, gone = check["outcome"] == "ok", check["outcome"] == "gone"
    again = (state["last"] == "gone") & (state["day"] == day)
    failures = F.when(ok, 0).when(gone & ~F.coalesce(again, F.lit(False)), state["failures"] + 1).otherwise(state["failures"])
    down = gone & (state["status"] != "inactive") & (failures >= CONFIRMATIONS)
    up = ok & (state["status"] == "inactive")
    known = state["price"].isNotNull() & check["price"].isNotNull() & (state["price"] > 0)
    apart = F.try_divide(F.abs(check["price"] - state["price"]), F.nullif(state["price"], F.lit(0.0)))
    moved = ok & known & (F.abs(check["price"] - state["price"]) >= 1)
    taken = moved & (apart <= MOST_CHANGE)
    price = F.when(ok & state["price"].isNull(), check["price"]).when(taken, check["price"]).otherwise(state["price"])
    event = lambda when, name: F.when(when, F.struct(check["at"].alias("at"), F.lit(name).alias("event"), check["price"].alias("price")))
    new = F.array_compact(F.array(event(down, "deactivated"), event(up, "reactivated"), event(taken, "price_change"), event(moved & ~taken, "price_unconfirmed")))
    return F.struct(
        F.when(down, "inactive").when(up, "active").otherwise(state["status"]).alias("status"), failures.alias("failures"), price.alias("price"),
        check["outcome"].alias("last"), day.alias("day"), F.concat(state["events"], new).alias("events"),
    )


def fold(checks: DataFrame, listing: str) -> DataFrame:
    """``listing, status, failures, price, events`` from ``checks(listing, at, outcome, price, seq)``.

    The checks of one listing are few (one a day); they are gathered by listing and folded in order.
    """
    start = F.struct(F.lit("active").alias("status"), F.lit(0).alias("failures"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("date").alias("day"), F.expr(f"cast(array() as array<{EVENT}>)").alias("events"))
    own = checks.groupBy(listing).agg(F.array_sort(F.collect_list(F.struct("at", "seq", "outcome", "price"))).alias("checks"))
    out = own.select(listing, F.aggregate("checks", start, step).alias("s"))
    return out.select(listing, "s.status", "s.failures", "s.price", "s.events")


