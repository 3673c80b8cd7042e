"""The load gate: what is loaded is asked about once, an answer counts for an hour and for the bytes that were shown.

Events (uid, name, tool, id, hash, worst, mode, succeeded, at) come from hooks. Before a load the gate decides by the content's hash: what was
accepted or remembered before passes silently, what is quiet is remembered, what has findings below the threshold is noted, and the
rest is asked about, or denied where the session answers for its user. After a load that was asked about, the same hash is accepted and
another one is not. Events are judged in the order of their time, then of their uid, and a uid that comes again is the same event.

The rules are the same on tables and on streams. On tables an approval is the least event of a hash that approves it, so that a
hash with most of the events is no large group; on streams two keyed states follow each other, by call and then by content, whose
events wait for the watermark to pass them, so that late ones are judged in their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TTL = "1 hour"
TTL_MS = 3_600_000
TOOL = "Skill"
#: Modes in which a session answers for its user. Fixed values.
ANSWERED = ("auto", "bypass")
#: Ranks of findings: from here on a load is asked about, and from here on it is not remembered. Fixed values.
BLOCKING, NOTED = 3, 2

OUT = "uid long, hash string, at timestamp, decision string"
#: What the first state gives the second: a load, or an answer to what was asked (asked_at, asked_uid), about the same bytes or others.
STEP = "uid long, hash string, at timestamp, answer boolean, same boolean, asked_at timestamp, asked_uid long, worst int, mode string"


def decide(findings: str, mode: str, known: str) -> Column:
    """allow, ask or deny: known content passes, clean content passes, an ask becomes a deny where the session answers for the user."""
    ask = F.when(F.col(mode).isin("auto", "bypass"), "deny").otherwise("ask")
    return F.when(F.col(known), "allow").when(F.col(findings) == 0, "allow").otherwise(ask)


def confirmations(asks: DataFrame, confirms: DataFrame) -> DataFrame:
    """asks (id, hash, at) and confirms (id, hash, at) to approvals (id, hash, asked_at, confirmed_at).

    The confirmation comes at the ask's time or up to an hour later, the hour itself included. On streams both
    sides carry watermarks, so that state older than the hour is dropped.
    """
    if asks.isStreaming:
        asks, confirms = asks.withWatermark("at", TTL), confirms.withWatermark("at", TTL)
    a = asks.select(F.col("id").alias("a_id"), F.col("hash").alias("a_hash"), F.col("at").alias("asked_at"))
    c = confirms.select(F.col("id").alias("c_id"), F.col("hash").alias("c_hash"), F.col("at").alias("confirmed_at"))
    within = F.expr(f"confirmed_at >= asked_at and confirmed_at <= asked_at + interval {TTL}")
    return a.join(c, (F.col("a_id") == F.col("c_id")) & (F.col("a_hash") == F.col("c_hash")) & within).select(F.col("a_id").alias("id"), F.col("a_hash").alias("hash"), "asked_at", "confirmed_at")


def route(events: DataFrame) -> DataFrame:
    """The events that concern the gate: before a load of its tool, and after one that succeeded. All others are ignored."""
    after = (F.col("name") == "PostToolUse") & F.col("succeeded")
    kept = events.filter((F.col("tool") == TOOL) & ((F.col("name") == "PreToolUse") | after) & F.col("at").isNotNull() & F.col("uid").isNotNull())
    return kept.select("uid", (F.col("name") == "PostToolUse").alias("answer"), "id", "hash", F.coalesce("worst", F.lit(0)).cast("int").alias("worst"), F.coalesce("mode", F.lit("")).alias("mode"), "at")


def gate(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """uid, hash, at and decision: allow, remembered, noted, ask, deny for loads, accepted or changed for answers to what was asked.

    An answer to nothing, or later than an hour, gives no row. On a stream, which needs the RocksDB state store, events that are
    later than `delay` behind the newest one are dropped.
    """
    routed = route(events)
    if events.isStreaming:
        first = routed.withWatermark("at", delay).groupBy("id").transformWithStateInPandas(Calls(), STEP, "Append", "EventTime", eventTimeColumnName="at")
        return first.groupBy("hash").transformWithStateInPandas(Contents(), OUT, "Append", "EventTime", eventTimeColumnName="at")
    return _of_table(routed.dropDuplicates(["uid"]))


def _asks(worst, mode):
    return (worst >= BLOCKING) & ~mode.isin(*ANSWERED)


def _of_table(routed: DataFrame) -> DataFrame:
    # an answer is about the last thing of its call, if that was asked and not answered yet
    calls = Window.partitionBy("id").orderBy("at", "uid")
    own = F.struct("answer", "hash", "at", "uid")
    counts = routed.filter(F.col("answer") | _asks(F.col("worst"), F.col("mode"))).withColumn("last", F.lag(own).over(calls))
    answers = counts.filter(F.col("answer") & ~F.col("last.answer") & F.expr(f"at <= last.at + interval {TTL}"))
    answers = answers.select("uid", F.col("last.hash").alias("hash"), "at", F.lit(True).alias("answer"), F.col("hash").eqNullSafe(F.col("last.hash")).alias("same"), F.col("last.at").alias("asked_at"), F.col("last.uid").alias("asked_uid"), F.lit(0).alias("worst"), F.lit("").alias("mode"))
    loads = routed.filter(~F.col("answer")).select("uid", "hash", "at", "answer", F.lit(False).alias("same"), F.col("at").alias("asked_at"), F.col("uid").alias("asked_uid"), "worst", "mode")
    steps = loads.unionByName(answers)
    approves = F.when(F.col("answer"), F.col("same")).otherwise(F.col("worst") < NOTED)
    first = steps.filter(approves & F.col("hash").isNotNull()).groupBy("hash").agg(F.min(F.struct("at", "uid")).alias("first"))
    seen = steps.join(first, "hash", "left").withColumn("known", F.col("first").isNotNull() & (F.struct("asked_at", "asked_uid") > F.struct("first.at", "first.uid")))
    quiet = F.when(F.col("hash").isNull(), "noted").otherwise("remembered")
    load = F.when(F.col("known"), "allow").when(F.col("worst") < NOTED, quiet).when(F.col("worst") < BLOCKING, "noted").when(F.col("mode").isin(*ANSWERED), "deny").otherwise("ask")
    answer = F.when(~F.col("known"), F.when(F.col("same"), "accepted").otherwise("changed"))
    return seen.select("uid", "hash", "at", F.when(F.col("answer"), answer).otherwise(load).alias("decision")).filter("decision is not null")


class InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then hands them to judge() by time, then by uid, each uid once."""

    SCHEMA: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        self.waiting = handle.getListState("waiting", self.SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Spark has left out what is behind the watermark; what it has just passed comes from the state before and is due at once
        for batch in rows:
            batch = batch[self.names]
            for row in batch.itertuples(index=False):
                self.waiting.appendValue(tuple(_plain(x) for x in row))
            for at in {_ms(t) for t in batch["at"]}:
                self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due_at = expiredTimerInfo.getExpiryTimeInMs()
        held = [dict(zip(self.names, r)) for r in self.waiting.get()]
        due = {r["uid"]: r for r in held if _ms(r["at"]) <= due_at}
        rest = [tuple(r[n] for n in self.names) for r in held if _ms(r["at"]) > due_at]
        self.waiting.put(rest) if rest else self.waiting.clear()
        out = [x for r in sorted(due.values(), key=lambda r: (r["at"], r["uid"])) for x in self.judge(key[0], r)]
        if out:
            yield pd.DataFrame(out)

    def judge(self, key, row: dict) -> list[dict]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _ms(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


def _plain(value):
    """A value as a state takes it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


class Calls(InOrder):
    """By call: what was asked last, until it is answered or an hour old."""

    SCHEMA = "uid long, answer boolean, hash string, worst int, mode string, at timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pending = handle.getValueState("pending", "hash string, at timestamp, uid long")
        self.last = handle.getValueState("last", "uid long, at timestamp")

    def judge(self, key, row: dict) -> list[dict]:
        if self._again(row):
            return []
        if not row["answer"]:
            if row["worst"] >= BLOCKING and row["mode"] not in ANSWERED:
                self.pending.update((row["hash"], row["at"], row["uid"]))
                # nothing is kept for longer than an answer counts
                self.handle.registerTimer(_ms(row["at"]) + TTL_MS + 1)
            return [{"uid": row["uid"], "hash": row["hash"], "at": row["at"], "answer": False, "same": False, "asked_at": row["at"], "asked_uid": row["uid"], "worst": row["worst"], "mode": row["mode"]}]
        if not self.pending.exists():
            return []
        asked, at, uid = self.pending.get()
        self.pending.clear()
        if _ms(row["at"]) - _ms(at) > TTL_MS:
            return []
        return [{"uid": row["uid"], "hash": asked, "at": row["at"], "answer": True, "same": row["hash"] == asked, "asked_at": at, "asked_uid": uid, "worst": 0, "mode": ""}]

    def _again(self, row: dict) -> bool:
        """Whether the row is one that was judged; repeats of later batches come behind it in order."""
        if self.last.exists():
            uid, at = self.last.get()
            if (row["at"], row["uid"]) <= (at, uid):
                return True
        self.last.update((row["uid"], row["at"]))
        return False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.pending.exists() and expiredTimerInfo.getExpiryTimeInMs() > _ms(self.pending.get()[1]) + TTL_MS:
            self.pending.clear()


class Contents(InOrder):
    """By content: the event that approved it first."""

    SCHEMA = STEP

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", "at timestamp, uid long")

    def judge(self, key, row: dict) -> list[dict]:
        known = self.first.exists() and (row["asked_at"], row["asked_uid"]) > tuple(self.first.get())
        if row["answer"]:
            if known:
                return []
            decision = "accepted" if row["same"] else "changed"
        elif known:
            decision = "allow"
        elif row["worst"] < NOTED:
            decision = "noted" if key is None else "remembered"
        else:
            decision = "noted" if row["worst"] < BLOCKING else "deny" if row["mode"] in ANSWERED else "ask"
        if decision in ("accepted", "remembered") and key is not None and not self.first.exists():
            self.first.update((row["at"], row["uid"]))
        return [{"uid": row["uid"], "hash": key, "at": row["at"], "decision": decision}]
