"""Online intake of submissions: duplicates within a horizon and caps for each hour and day.

The batch forms give the whole answer over a table of events; the stream forms keep the same rules
in state, so that replaying a table through them admits the same events.  In both, only what was
admitted counts: a refused repeat extends no horizon, a refused attempt uses up no cap.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.components import connected_components
from tessera.session import cut_lineage, unused


def first_within(events: DataFrame, key: list[str], ts: str, tie: str, horizon: str) -> DataFrame:
    """Events that come more than ``horizon`` after the last admitted one of their key, and each key's first.

    An event further than that from its predecessor is admitted whatever came before.  From there on
    the next admitted one is the first past the horizon, so the rest are found by following these
    pointers, twice as far in each round; no task holds a key's events.
    """
    span = F.expr(f"INTERVAL {horizon}")
    order = Window.partitionBy("k").orderBy("t", "i")
    rows = events.select(F.struct(*[F.col(c) for c in key]).alias("k"), F.col(ts).alias("t"), F.col(tie).alias("i"), F.struct(*events.columns).alias("event"))
    before = F.lag("t").over(order)
    rows = cut_lineage(rows.withColumn("n", F.row_number().over(order)).withColumn("head", before.isNull() | (F.col("t") > before + span)))
    # The nearest event after each one's horizon: latest first, events before the horizons that end with them.
    ends = rows.select("k", (F.col("t") + span).alias("t"), F.col("n").alias("of"), F.lit(None).cast("struct<n:int,head:boolean>").alias("seen"))
    ends = ends.unionByName(rows.select("k", "t", F.lit(None).cast("int").alias("of"), F.struct("n", "head").alias("seen")))
    # At equal times the horizon stands first, so it does not see an event that is not past it.
    latest = Window.partitionBy("k").orderBy(F.desc("t"), F.col("of").isNull(), F.desc("seen")).rowsBetween(Window.unboundedPreceding, 0)
    links = ends.withColumn("next", F.last("seen", ignorenulls=True).over(latest)).where("of is not null and next is not null and not next.head")
    links = cut_lineage(links.select("k", F.col("of").alias("n"), F.col("next.n").alias("to")))
    marked = rows.where("head").select("k", "n")
    while True:
        found = cut_lineage(marked.join(links, ["k", "n"]).select("k", F.col("to").alias("n")).join(marked, ["k", "n"], "left_anti").distinct())
        if found.isEmpty():
            return rows.join(marked, ["k", "n"]).select("event.*")
        marked = cut_lineage(marked.unionByName(found))
        links = cut_lineage(links.join(links.select("k", F.col("n").alias("to"), F.col("to").alias("far")), ["k", "to"]).select("k", "n", F.col("far").alias("to")))


@dataclass(frozen=True)
class Cap:
    """At most ``limit`` admitted events with equal ``keys`` in one calendar ``unit`` (hour, day), or in any ``span`` of time."""

    limit: int
    keys: tuple[str, ...] = ()
    unit: str | None = None
    span: str | None = None
    name: str | None = None

    @property
    def reason(self) -> str:
        return self.name or "_".join([self.unit or "span", *self.keys])


def _counted(rows: DataFrame, caps: list[Cap]) -> DataFrame:
    """Adds for each cap the events before it that are admitted (sure_k), and those that may be (may_k)."""
    running = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sure, may = F.coalesce("admitted", F.lit(False)).cast("int"), F.coalesce("admitted", F.lit(True)).cast("int")
    for k, cap in enumerate(caps):
        if cap.unit:
            window = Window.partitionBy(F.date_trunc(cap.unit, "t"), *[f"key_{c}" for c in cap.keys]).orderBy("t", "i", "row").rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn(f"sure_{k}", running(sure, window)).withColumn(f"may_{k}", running(may, window))
            continue
        # Each event once at its time and once where its span begins; what was admitted before that no longer counts.
        keys = [f"key_{c}" for c in cap.keys]
        ends = rows.select("row", "t", "i", *keys, sure.alias("s"), may.alias("m"), F.lit(1).alias("sign"))
        begins = rows.select("row", (F.col("t") - F.expr(f"INTERVAL {cap.span}")).alias("t"), "i", *keys, F.lit(0).alias("s"), F.lit(0).alias("m"), F.lit(-1).alias("sign"))
        window = Window.partitionBy(*keys).orderBy("t", "sign", "i", "row").rowsBetween(Window.unboundedPreceding, -1)
        counted = ends.unionByName(begins).select("row", (running(F.col("s"), window) * F.col("sign")).alias("s"), (running(F.col("m"), window) * F.col("sign")).alias("m"))
        rows = rows.join(counted.groupBy("row").agg(F.sum("s").alias(f"sure_{k}"), F.sum("m").alias(f"may_{k}")), "row")
    return rows


#: Rounds that decide all events at once, before what is still open is taken in order.
MOST_ROUNDS = 8


def _in_order(rows: DataFrame, caps: list[Cap]) -> DataFrame:
    """``row`` and ``admitted`` of the open rows (null), one after the other beside the admitted ones that they share a group with."""
    groups = []
    for k, cap in enumerate(caps):
        bucket = F.unix_micros(F.date_trunc(cap.unit, "t").cast("timestamp")) if cap.unit else F.lit(0).cast("long")
        groups.append(F.struct(F.lit(k).alias("cap"), F.to_json(F.array(*[F.coalesce(F.col(f"key_{c}").cast("string"), F.lit("\x00")) for c in cap.keys] or [F.lit("")])).alias("key"), bucket.alias("bucket")))
    each = rows.select("row", "admitted", F.explode(F.array(*groups)).alias("g"))
    pending = each.where("admitted is null").select("row", "g")
    first = pending.groupBy("g").agg(F.min("row").alias("first"))
    linked = connected_components(pending.join(first, "g").where("row <> first"), "row", "first")
    component = rows.where("admitted is null").select("row").join(linked, F.col("row") == F.col("node"), "left").select("row", F.coalesce("component", "row").alias("component"))
    # A group's open rows are of one component, so its least one names it.
    of_group = first.join(component, F.col("first") == component["row"]).select("g", "component")
    beside = each.where("admitted").join(of_group, "g").select("row", "component").distinct()
    span = [pd.Timedelta(cap.span.lower()) // pd.Timedelta("1us") if cap.span else 0 for cap in caps]
    stream = component.unionByName(beside).join(rows.select("row", F.unix_micros(F.col("t").cast("timestamp")).alias("t"), "i", "admitted", F.array(*groups).alias("groups")), "row")
    ordered = stream.repartition(F.xxhash64("component")).sortWithinPartitions("component", "t", "i", "row").select("component", "row", "t", "admitted", "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, times = None, {}, {}
        for batch in batches:
            out_rows, out = [], []
            for component_of, row, t, decided, own in zip(*(batch.column(c).to_pylist() for c in ("component", "row", "t", "admitted", "groups")), strict=True):
                if component_of != now:
                    now, counts, times = component_of, {}, {}
                room = True
                for g in own:
                    cap, key = caps[g["cap"]], (g["cap"], g["key"])
                    if cap.unit:
                        if counts.get(key, (None, 0))[0] != g["bucket"]:
                            counts[key] = (g["bucket"], 0)
                        room = room and counts[key][1] < cap.limit
                    else:
                        held = times.setdefault(key, deque())
                        while held and held[0] < t - span[g["cap"]]:
                            held.popleft()
                        room = room and len(held) < cap.limit
                if decided is None:
                    out_rows.append(row)
                    out.append(room)
                if decided or decided is None and room:
                    for g in own:
                        key = (g["cap"], g["key"])
                        if caps[g["cap"]].unit:
                            counts[key] = (counts[key][0], counts[key][1] + 1)
                        else:
                            times[key].append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out_rows, pa.int64()), pa.array(out, pa.bool_())], ["row", "admitted"])

    return ordered.mapInArrow(run, "row long, admitted boolean")


def capped(events: DataFrame, ts: str, tie: str, caps: list[Cap], closed: Column | None = None) -> DataFrame:
    """Adds ``admitted`` and ``reason``, the name of the first cap that refuses the event.

    Events are taken by ``ts`` and ``tie``; one is admitted if every cap still has room after those
    admitted before it, and only then does it count.  ``closed``, a condition on the event, refuses
    it outright with the reason ``closed``.

    All events are decided together in a few rounds: one is admitted once even those that may be admitted
    before it leave room, and refused once those surely admitted leave none.  What is open after
    ``MOST_ROUNDS`` hangs in a chain, where each event waits for the one before.  Open events that share
    a group (a key's events in one unit of time, or of one key where a cap has a span) stream in order
    through one task, which remembers counts and times of open groups, never events.
    """
    (row,) = unused(events, "row")
    numbered = cut_lineage(events.withColumn(row, F.monotonically_increasing_id()))
    keys = sorted({c for cap in caps for c in cap.keys})
    shut = F.coalesce(closed, F.lit(False)) if closed is not None else F.lit(False)
    rows = numbered.where(~shut).select(F.col(row).alias("row"), F.col(ts).alias("t"), F.col(tie).alias("i"), *[F.col(c).alias(f"key_{c}") for c in keys], F.lit(None).cast("boolean").alias("admitted"))
    open_rows, shape, waiting = rows, rows.columns, True
    for _ in range(MOST_ROUNDS):
        counted = _counted(open_rows, caps)
        room, full = F.lit(True), F.lit(False)
        for k, cap in enumerate(caps):
            room, full = room & (F.col(f"may_{k}") < cap.limit), full | (F.col(f"sure_{k}") >= cap.limit)
        decided = F.when(F.col("admitted").isNotNull(), F.col("admitted")).when(room, True).when(full, False)
        # Refused events count for nothing and need no further round.
        open_rows = cut_lineage(counted.withColumn("admitted", decided).where(F.coalesce("admitted", F.lit(True))).select(*shape))
        waiting = not open_rows.where("admitted is null").isEmpty()
        if not waiting:
            break
    if waiting:
        found = _in_order(open_rows, caps)
        open_rows = cut_lineage(open_rows.join(found.withColumnRenamed("admitted", "late"), "row", "left").withColumn("admitted", F.coalesce("admitted", "late")).where("admitted").select(*shape))
    settled = rows.drop("admitted").join(open_rows.select("row", "admitted"), "row", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
    counted = _counted(settled, caps)
    reason = F.coalesce(*[F.when(F.col(f"sure_{k}") >= cap.limit, cap.reason) for k, cap in enumerate(caps)], F.lit(None).cast("string"))
    reasons = counted.select(F.col("row").alias(row), "admitted", F.when(~F.col("admitted"), reason).alias("reason"))
    out = numbered.join(reasons, row, "left").withColumn("reason", F.when(shut, "closed").otherwise(F.col("reason")))
    return out.withColumn("admitted", F.coalesce("admitted", F.lit(False))).select(*events.columns, "reason", "admitted")


def switched_off(events: DataFrame, switches: DataFrame, ts: str, tie: str, disabled: str = "disabled") -> DataFrame:
    """Adds ``closed``: whether the last switch at or before the event is off; without one, intake is open."""
    both = events.select(F.col(ts).alias("t"), F.col(tie).alias("i"), F.struct(*events.columns).alias("event"), F.lit(None).cast("boolean").alias("off"))
    both = both.unionByName(switches.select(F.col(ts).alias("t"), F.col(tie).alias("i"), F.lit(None).cast(both.schema["event"].dataType).alias("event"), F.col(disabled).alias("off")))
    # Switches are few: their times, numbered in order, cut the events into ranges of days first.
    day = F.date_trunc("day", "t")
    last = Window.partitionBy("day").orderBy("t", F.col("event").isNotNull(), "i").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("day", day).withColumn("today", F.last("off", ignorenulls=True).over(last))
    days = both.groupBy("day").agg(F.max_by("off", F.when(F.col("off").isNotNull(), F.struct("t", "i"))).alias("off_end"))
    carried = days.withColumn("off_before", F.last("off_end", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "off_before")
    return both.where("event is not null").join(carried, "day").select("event.*", F.coalesce("today", "off_before", F.lit(False)).alias("closed"))


def deduplicated_stream(events: DataFrame, key: list[str], ts: str, horizon: str) -> DataFrame:
    """A stream without repeats of a key within the horizon; the state of older keys expires."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(key)


def hourly_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Attempts by hour and key, final once the watermark has passed the hour."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), key, "n")


def admitted_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int) -> DataFrame:
    """A stream with ``admitted``: the first ``limit`` events of each key and hour, in arrival order.

    State is one count for each key and hour and goes when its hour has timed out.
    """
    rows = events.select(F.col(key).cast("string").alias("key_of"), F.col(ts).alias("ts_of"), F.col(tie).cast("long").alias("tie_of")).withWatermark("ts_of", "1 hour").withColumn("hour_of", F.date_trunc("hour", "ts_of"))

    def admit(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values(["ts_of", "tie_of"])
            places = range(n + 1, n + len(rows) + 1)
            n += len(rows)
            yield pd.DataFrame({"key_of": rows["key_of"], "tie_of": rows["tie_of"], "admitted": [p <= limit for p in places]})
        state.update((n,))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark + 1, mark + 2 * 3_600_000))

    grouped = rows.groupBy("key_of", "hour_of")
    return grouped.applyInPandasWithState(admit, "key_of string, tie_of long, admitted boolean", "n long", "append", GroupStateTimeout.EventTimeTimeout)


#: Microseconds.
DAY = 86_400_000_000


@dataclass(frozen=True)
class Inbox:
    """The capacity of an inbox: accepted a day, held at once, and accepted a day of one key; it holds things for ``horizon``."""

    day_limit: int
    held_limit: int
    key_limit: int
    horizon: str

    def decide(self, rows: pd.DataFrame, held: list[tuple]) -> tuple[list[str], list[tuple]]:
        """Verdicts on rows (ts_of, key_of, hash_of) in order, and what is held after them."""
        keep, verdicts = pd.Timedelta(self.horizon) // pd.Timedelta("1us"), []
        micros = rows["ts_of"].astype("datetime64[us]").astype("int64").tolist()
        for at, key, hashed in zip(micros, rows["key_of"], rows["hash_of"], strict=True):
            while held and held[0][0] < at - keep:
                held = held[1:]
            today = [x for x in held if x[0] // DAY == at // DAY]
            if any(x[2] == hashed for x in held):
                verdict = "duplicate"
            elif len(today) >= self.day_limit or len(held) >= self.held_limit:
                verdict = "daily_capacity"
            elif sum(x[1] == key for x in today) >= self.key_limit:
                verdict = "rate_limited"
            else:
                verdict, held = "accepted", [*held, (at, key, hashed)]
            verdicts.append(verdict)
        return verdicts, held


def _inbox_rows(events: DataFrame, inbox: str, ts: str, tie: str, key: str, hashed: str) -> DataFrame:
    return events.select(F.col(inbox).cast("string").alias("inbox_of"), F.col(ts).alias("ts_of"), F.col(tie).cast("long").alias("tie_of"), F.col(key).cast("string").alias("key_of"), F.col(hashed).cast("string").alias("hash_of"))


def inbox_verdicts(events: DataFrame, rule: Inbox, inbox: str, ts: str, tie: str, key: str, hashed: str) -> DataFrame:
    """``inbox_of``, ``tie_of`` and ``verdict`` of each event: accepted, duplicate, daily_capacity or rate_limited.

    An inbox takes its events one after the other by ``ts`` and ``tie``, and each verdict depends on
    all before it, so an inbox's events stream through one task in order; the task remembers what the
    inbox holds, ``held_limit`` entries at most, and never its events.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            verdicts = []
            for _, rows in batch.groupby(batch["inbox_of"].ne(batch["inbox_of"].shift()).cumsum(), sort=False):
                if now is None or rows["inbox_of"].iloc[0] != now[0]:
                    now, held = (rows["inbox_of"].iloc[0],), []
                found, held = rule.decide(rows, held)
                verdicts += found
            yield pd.DataFrame({"inbox_of": batch["inbox_of"], "tie_of": batch["tie_of"], "verdict": verdicts})

    rows = _inbox_rows(events, inbox, ts, tie, key, hashed).where("inbox_of is not null")
    return rows.repartition("inbox_of").sortWithinPartitions("inbox_of", "ts_of", "tie_of").mapInPandas(run, "inbox_of string, tie_of long, verdict string")


def inbox_stream(events: DataFrame, rule: Inbox, inbox: str, ts: str, tie: str, key: str, hashed: str) -> DataFrame:
    """``inbox_verdicts`` of a stream, in arrival order; the state of an inbox is what it holds.

    A silent inbox keeps its state; ``expiring_inbox_stream`` lets it go.
    """

    def decide(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            rows = rows.sort_values(["ts_of", "tie_of"])
            verdicts, held = rule.decide(rows, held)
            yield pd.DataFrame({"inbox_of": rows["inbox_of"], "tie_of": rows["tie_of"], "verdict": verdicts})
        state.update(tuple([x[c] for x in held] for c in range(3)))

    rows = _inbox_rows(events, inbox, ts, tie, key, hashed)
    return rows.groupBy("inbox_of").applyInPandasWithState(decide, "inbox_of string, tie_of long, verdict string", "times array<long>, keys array<string>, hashes array<string>", "append", GroupStateTimeout.NoTimeout)


class _HeldUntil(StatefulProcessor):
    """What an inbox holds, with a timer for the oldest of it."""

    def __init__(self, rule: Inbox):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<bigint>, keys array<string>, hashes array<string>")

    def _keep(self, held: list[tuple]) -> None:
        """Remember what is held and wake up when its oldest has expired; an empty inbox leaves nothing."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not held:
            self.held.clear()
            return
        self.held.update(tuple([x[c] for x in held] for c in range(3)))
        self.handle.registerTimer((held[0][0] + pd.Timedelta(self.rule.horizon) // pd.Timedelta("1us")) // 1000 + 1)

    def _read(self) -> list[tuple]:
        return list(zip(*self.held.get(), strict=True)) if self.held.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._read()
        for batch in rows:
            batch = batch.sort_values(["ts_of", "tie_of"])
            verdicts, held = self.rule.decide(batch, held)
            yield pd.DataFrame({"inbox_of": batch["inbox_of"], "tie_of": batch["tie_of"].astype("Int64"), "verdict": verdicts, "n_held": len(held)})
        self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._read()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        keep = pd.Timedelta(self.rule.horizon) // pd.Timedelta("1us")
        left = [x for x in held if x[0] >= now - keep]
        self._keep(left)
        yield pd.DataFrame({"inbox_of": [key[0]], "tie_of": pd.array([None], "Int64"), "verdict": ["expired"], "n_held": [len(left)]})

    def close(self) -> None:
        pass


def expiring_inbox_stream(events: DataFrame, rule: Inbox, inbox: str, ts: str, tie: str, key: str, hashed: str, *, late: str = "1 hour") -> DataFrame:
    """``inbox_stream`` whose inboxes empty by themselves: a timer drops what is older than the horizon.

    Adds ``n_held``, what the inbox holds after the batch; a timer's row has a null tie and the verdict
    ``expired``.  Time is the events', up to ``late`` behind the latest; events later than that, and of a
    null inbox, are passed over.  An inbox that holds nothing has no state and no timer.  The session must
    use the RocksDB state store.
    """
    rows = _inbox_rows(events, inbox, ts, tie, key, hashed).where("inbox_of is not null").withWatermark("ts_of", late)
    return rows.groupBy("inbox_of").transformWithStateInPandas(_HeldUntil(rule), "inbox_of string, tie_of long, verdict string, n_held long", "Append", "EventTime")


def reservations(events: DataFrame, key: str, ts: str, tie: str, action: str, ttl: str) -> DataFrame:
    """Two-phase intake: a commit stands if its key has a reservation of at most ``ttl`` before it.

    Returns the commits with ``status`` committed, expired or unknown.
    """
    order = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    held = events.withColumn("reserved_at", F.last(F.when(F.col(action) == "reserve", F.col(ts)), ignorenulls=True).over(order))
    status: Column = F.when(F.col("reserved_at").isNull(), "unknown").when(F.col(ts) > F.col("reserved_at") + F.expr(f"INTERVAL {ttl}"), "expired").otherwise("committed")
    return held.where(F.col(action) == "commit").withColumn("status", status).drop("reserved_at")
