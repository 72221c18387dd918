"""Streaming forms: counters and histograms by window, access audit, fixed-window limiter, vote tally."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracework.operators.access import audit, decide


def windowed_counters(events: DataFrame, ts: str, label: str, x: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and label; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("total")
    ).select(F.col("window.start").alias("window_start"), label, "n", "total")


def access_audit(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Audit rows of a stream of requests against a static table of policies."""
    return audit(decide(requests, policies))


def limit_requests(log: DataFrame, limit: int, window_s: float, skip=None) -> DataFrame:
    """Fixed-window limiter, batch form: ``key, ts, id, allowed, remaining``.

    Requests for which ``skip``, a column expression, is true pass uncounted (``remaining`` is null).

    ``log`` has key, ts and id. A window starts at a key's first request and again
    at the first one after its end; requests over the limit are denied and not
    counted. The window depends on all before it, so rows fold in order of time;
    they are read as they stream through a partition sorted by key and time, and
    only the current key's window is held, however many requests it has.
    """
    schema = "key string, ts timestamp, id long, allowed boolean, remaining int"
    width = pd.Timedelta(seconds=window_s)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = object(), None, 0
        for pdf in batches:
            allowed, remaining = [], []
            for k, t, free in zip(pdf["key"], pdf["ts"], pdf["skip"]):
                if free:
                    allowed.append(True)
                    remaining.append(None)
                    continue
                if k != key or t > start + width:
                    key, start, count = k, t, 0
                ok = count < limit
                count += ok
                allowed.append(ok)
                remaining.append(limit - count)
            yield pdf.drop(columns="skip").assign(allowed=allowed, remaining=pd.array(remaining, "Int32"))

    passed = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    rows = log.select(F.col("key").cast("string").alias("key"), "ts", F.col("id").cast("long").alias("id"), passed.alias("skip"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(fold, schema)


def client_key(user, forwarded, address, path):
    """Who a limiter counts: the user, else the first forwarded address, else the address, else ``unknown``, with the path."""
    first = F.trim(F.split(forwarded, ",")[0])
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(":", F.coalesce(blank(user), blank(first), blank(address), F.lit("unknown")), path)


#: State store for streams with timers and maps: large state lies on disk, with its changes in the checkpoint folder.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own with ``STATE_STORE`` set, for streams with ``transformWithStateInPandas``; the caller's stays as it is."""
    own = spark.newSession()
    for name, value in STATE_STORE.items():
        own.conf.set(name, value)
    return own


def _ms(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


class WindowLimiter(StatefulProcessor):
    """Fixed windows of each key: one small value a key, let go by a timer at the end of its window."""

    def __init__(self, limit: int, window_s: float):
        self.limit, self.width = limit, pd.Timedelta(seconds=window_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start timestamp, n int")

    def _timer(self, start, now: int, old=None) -> None:
        if old is not None:
            self.handle.deleteTimer(_ms(old + self.width))
        self.handle.registerTimer(max(_ms(start + self.width), now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.window.get() if self.window.exists() else None
        start, count = (pd.Timestamp(held[0]), held[1]) if held else (None, 0)
        before, out = start, []
        pdf = pd.concat(list(rows)).sort_values(["ts", "id"])
        for t, i, skip in zip(pdf["ts"], pdf["id"], pdf["skip"]):
            if skip:
                out.append((key[0], t, i, True, None, pd.NaT, 0.0))
                continue
            if start is None or t > start + self.width:
                start, count = t, 0
            ok = count < self.limit
            count += ok
            wait = 0.0 if ok else (start + self.width - t).total_seconds()
            out.append((key[0], t, i, ok, self.limit - count, start + self.width, wait))
        if start is not None:
            self.window.update((start.to_pydatetime(), count))
            if before is None or start != before:
                self._timer(start, timerValues.getCurrentWatermarkInMs(), before)
        made = pd.DataFrame(out, columns=["key", "ts", "id", "allowed", "remaining", "reset", "retry_s"])
        made["remaining"] = made["remaining"].astype("Int32")
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_stream(log: DataFrame, limit: int, window_s: float, late: str = "10 minutes", skip=None) -> DataFrame:
    """Fixed-window limiter of a stream ``key, ts, id``: as ``limit_requests``, with reset time and seconds to wait.

    One window is held for each key and let go by a timer once the watermark
    passes its end. Rows of a key fold in order of time within a batch; batches in
    their order. Needs a session with ``STATE_STORE``.
    """
    schema = "key string, ts timestamp, id long, allowed boolean, remaining int, reset timestamp, retry_s double"
    passed = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    rows = log.select(F.col("key").cast("string").alias("key"), "ts", F.col("id").cast("long").alias("id"), passed.alias("skip"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(WindowLimiter(limit, window_s), schema, "Append", "EventTime")


class VoteTally(StatefulProcessor):
    """The last vote of each voter of a proposal in a map, and a timer for its end."""

    def __init__(self, quorum: int, timeout_s: float):
        self.quorum, self.timeout_ms = quorum, int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.votes = handle.getMapState("votes", "voter long", "vote string, at timestamp")
        self.meta = handle.getValueState("meta", "first timestamp, timer long, done boolean")

    def _counts(self) -> tuple[int, int, int]:
        said = [v[0] for v in self.votes.values()]
        return said.count("APPROVE"), said.count("REJECT"), len(said)

    def _row(self, key, decision: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], decision, *self._counts())], columns=["proposal_id", "decision", "approve", "reject", "total"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.meta.get() if self.meta.exists() else None
        first, timer, done = (pd.Timestamp(held[0]), held[1], held[2]) if held else (None, None, False)
        for pdf in rows:
            for voter, vote, t in zip(pdf["voter_id"], pdf["vote"], pdf["ts"]):
                first = t if first is None else min(first, t)
                old = None if done else self.votes.getValue((int(voter),))
                if not done and (old is None or pd.Timestamp(old[1]) <= t):
                    self.votes.updateValue((int(voter),), (vote, t.to_pydatetime()))
        decision = None
        if not done:
            approve, reject, _ = self._counts()
            if max(approve, reject) >= self.quorum:
                decision, done = "rejected" if reject >= self.quorum else "approved", True
        due = max(_ms(first) + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.meta.update((first.to_pydatetime(), timer, done))
        if decision:
            yield self._row(key, decision)
            self.votes.clear()  # a decided proposal needs no votes any more

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.meta.get() if self.meta.exists() else None
        if held and not held[2]:
            yield self._row(key, "timeout")
        self.votes.clear()
        self.meta.clear()

    def close(self) -> None:
        pass


def tally_stream(votes: DataFrame, quorum: int = 2, timeout_s: float = 5.0, late: str = "1 minute") -> DataFrame:
    """Decisions of a stream of votes ``proposal_id, voter_id, vote, ts``: ``proposal_id, decision, approve, reject, total``.

    The last vote of each voter counts. A proposal is approved or rejected once
    ``quorum`` voters say so (rejection is looked at first) and gives one row
    then; later votes change nothing. One still open when the watermark passes
    its first vote by ``timeout_s`` gives ``timeout``. All state of a proposal goes
    with its timer. Needs a session with ``STATE_STORE``.
    """
    schema = "proposal_id long, decision string, approve int, reject int, total int"
    rows = votes.select(F.col("proposal_id").cast("long").alias("proposal_id"), F.col("voter_id").cast("long").alias("voter_id"), "vote", "ts")
    return rows.withWatermark("ts", late).groupBy("proposal_id").transformWithStateInPandas(VoteTally(quorum, timeout_s), schema, "Append", "EventTime")


def label_key(labels: list[str]):
    """Labels in order of their names, as ``a="x",b="y"``; null ones are left out."""
    return F.concat_ws(",", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"'))) for c in sorted(labels)))


def windowed_histogram(events: DataFrame, ts: str, labels: list[str], x: str, bounds: list[float], width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Cumulative buckets by window and labels: ``window_start, labels, n, sum, count, le_...``; for update mode.

    ``n`` counts rows, ``count`` those with a value; a null is in no bucket. Rows
    whose window the watermark has passed are dropped; ``late_rows`` counts them.
    The same over a table gives all windows.
    """
    rows = events.withColumn("labels", label_key(labels)).withWatermark(ts, late)
    below = [F.count_if(F.col(x) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    made = rows.groupBy(F.window(ts, width).alias("w"), "labels").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.count(x).alias("count"), *below
    )
    return made.select(F.col("w.start").alias("window_start"), *(c for c in made.columns if c != "w"))


def _last_updates(updates: DataFrame) -> DataFrame:
    """The last row that update mode gave of each window and label map: ``n`` only grows."""
    names = [c for c in updates.columns if c not in ("window_start", "labels")]
    return updates.groupBy("window_start", "labels").agg(F.max_by(F.struct(*names), "n").alias("m")).select("labels", "m.*")


def merged_histograms(updates: DataFrame) -> DataFrame:
    """One histogram for each label map from the rows that update mode gave, windows added up."""
    last = _last_updates(updates)
    return last.groupBy("labels").agg(F.round(F.sum("sum"), 6).alias("sum"), *(F.sum(c).alias(c) for c in last.columns if c not in ("labels", "sum")))


def late_rows(query, updates: DataFrame) -> int:
    """Rows of a drained query that came too late: those it read, over the progress it still knows, less those in its windows."""
    counted = _last_updates(updates).agg(F.sum("n")).first()[0] or 0
    return sum(int(p["numInputRows"]) for p in query.recentProgress) - counted
