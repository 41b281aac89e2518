"""Structured Streaming versions: the same functions as in batches, with watermarks and state that ends."""

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attest.operators import contradictions as X
from attest.operators import replies as P
from attest.operators import views as W
from attest.operators._store import shared_folder
from attest.sources.sinks import append_new, read_committed

STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, as processors with state need; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def table_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A table's files as a stream, so many a batch; the table may be a folder or one file."""
    # A stream takes a path to a single file only as a pattern.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source has now, into a table of the shared folder, and reads that."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    with state_store(spark):
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def end_of(writer) -> None:
    """Runs a stream that writes its own batches over all that its source has now."""
    writer.trigger(availableNow=True).start().awaitTermination()


class _Calls(StatefulProcessor):
    """Numbers a caller's calls within sessions; what is known of a caller goes when it has been idle for a gap."""

    def __init__(self, gap: float, limit: int):
        self.gap, self.limit = int(gap * 1_000_000), limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "last long, session long, nth long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, session, nth, timer = self.now.get() if self.now.exists() else (None, 0, 0, None)
        calls = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        at, out = calls["ts"].to_numpy("datetime64[us]").astype("int64").tolist(), []
        for event, ts in zip(calls["event_id"].tolist(), at, strict=True):
            new = last is None or ts - last > self.gap
            session, nth = (session + 1, 1) if new else (session, nth + 1)
            last = ts if last is None else max(last, ts)
            out.append((key[0], event, nth, nth <= self.limit, max(0, self.limit - nth)))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (last + self.gap) // 1000 + 1
        self.handle.registerTimer(timer)
        self.now.update((last, session, nth, timer))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "nth", "allowed", "remaining"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.now.clear()
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "nth": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool"), "remaining": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def rate_limit(calls: DataFrame, limit: int, gap_seconds: float = 60, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, ts) -> each call as it comes: its number in the caller's session, whether it is allowed, and how many remain.

    A session ends after an idle gap; so does what is kept of a caller, once the watermark is past it. A call that comes
    late counts where it comes; one that is later than the watermark allows is not put out.
    """
    keyed = calls.select("user_id", "event_id", "ts").withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(_Calls(gap_seconds, limit), "user_id long, event_id long, nth long, allowed boolean, remaining long", "append", "eventTime")


def doc_dedup(docs: DataFrame, stored: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """First arrivals of a text in its corpus that are not stored (corpus_id, content_hash) yet; state is bounded by the watermark.

    What is stored is joined by hash in every batch as it is at its start: a table of any size, dealt by the same keys.
    """
    keys = ["corpus_id", "content_hash"]
    docs = docs.withColumn("content_hash", F.sha2("text", 256)).withWatermark("ts", late)
    if stored is not None:
        docs = docs.join(stored.select(*keys).distinct(), keys, "left_anti")
    return docs.dropDuplicatesWithinWatermark(keys)


def run_progress(counts: DataFrame, gap: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Totals of each run once nothing has come for it for a gap; state ends with the run."""
    s = counts.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap)).agg(*(F.sum(c).alias(c) for c in ("processed", "triples", "claims", "quarantined")))
    return s.select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "processed", "triples", "claims", "quarantined")


def trace_stats(steps: DataFrame, size: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and error share by actor over sliding windows."""
    w = steps.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "actor_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("n_failed"))
    return w.select(F.col("window.start").alias("start"), "actor_type", "n", "n_failed", (F.col("n_failed") / F.col("n")).alias("error_share"))


def _batch(checkpoint: str, number: int) -> str:
    """An id of a batch that no other stream has."""
    return f"{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}_{number}"


def replies(stream: DataFrame, good: str, quarantine: str, checkpoint: str):
    """Checks replies as they come; each batch writes the good and the bad ones once, by reply. Lines that could not be read (``readers.model_replies``) are quarantined as they are."""
    def both(batch: DataFrame, number: int) -> None:
        checked = P.reply_schema_check(batch)
        if "broken" in batch.columns:
            checked = checked.withColumn("reason", F.when(F.col("broken").isNotNull(), "UNREADABLE_LINE").otherwise(F.col("reason")))
        ok, bad = P.quarantine_split(checked)
        append_new(ok.select("corpus_id", "reply_id", "json"), good, ["corpus_id", "reply_id"], _batch(checkpoint, number))
        append_new(bad.select("corpus_id", "reply_id", "reason", "raw_text"), quarantine, ["corpus_id", "reply_id"], _batch(checkpoint, number))

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


def decisions(stream: DataFrame, triples: DataFrame, findings: str, checkpoint: str, applied: str | None = None):
    """After each batch of decisions: conflicts of the subjects and predicates that it touches, those not stored yet.

    Of a batch's decisions on a triple the earliest by (decided_at, decision_id) counts, as in a batch run; of several
    batches the first to arrive. Decisions are kept in a table (applied, else beside findings), so approvals of earlier
    batches take part; subjects and predicates meet as relation_conflicts groups them.
    """
    applied = applied or f"{findings.rstrip('/')}_applied"
    keys = ["corpus_id", "sk", "pk"]
    named = triples.withColumns({"sk": X.norm(F.col("subject_text")), "pk": F.lower("predicate")})

    def scan(batch: DataFrame, number: int) -> None:
        new = batch.filter("decision in ('APPROVE', 'REJECT')").groupBy(F.col("item_id").alias("triple_id")).agg(F.min_by("decision", F.struct("decided_at", "decision_id")).alias("decision"))
        append_new(new, applied, ["triple_id"], _batch(checkpoint, number))
        decided = read_committed(batch.sparkSession, applied)
        touched = named.join(new.select("triple_id"), "triple_id", "left_semi").select(*keys).distinct()
        rows = named.join(touched, keys, "left_semi").join(decided.select("triple_id", "decision"), "triple_id", "left")
        approved = rows.filter("status = 'APPROVED' or (status = 'PENDING' and decision = 'APPROVE')").select(*triples.columns)
        append_new(X.relation_conflicts(approved), findings, ["corpus_id", "conflict_hash"], _batch(checkpoint, number))

    return stream.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)


class _Heartbeat(StatefulProcessor):
    """Emits a job when no heartbeat came for so long."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.last.get()[0] if self.last.exists() else None
        new = max(int(pdf["ts"].to_numpy("datetime64[us]").max().astype("int64")) for pdf in rows) // 1000
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old + self.wait)
            self.last.update((new,))
            self.handle.registerTimer(new + self.wait)
        yield pd.DataFrame({"job_id": pd.Series([], dtype="int64"), "last_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "last_ms": [last]})

    def close(self) -> None:
        pass


def job_heartbeat(beats: DataFrame, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """(job_id, ts) -> jobs that fell silent, with their last heartbeat in ms; needs the RocksDB state store (STATE)."""
    keyed = beats.withWatermark("ts", late).groupBy("job_id")
    return keyed.transformWithStateInPandas(_Heartbeat(minutes), "job_id long, last_ms long", "append", "eventTime")


class _Debate(StatefulProcessor):
    """Applies events in order; those that are illegal in a debate's state, or come after one that is later, are put out as refused."""

    def __init__(self, most_rounds: int):
        self.most = most_rounds
        self.moves = {(a, e): b for a, e, b in W.DEBATE_MOVES}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, round int, refused int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, number, refused, last = self.now.get() if self.now.exists() else ("CREATED", 0, 0, None)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        at, out = events["ts"].to_numpy("datetime64[us]").astype("int64").tolist(), []
        for i, e, ts in zip(events["event_id"].tolist(), events["event"].tolist(), at, strict=True):
            to = self.moves.get((state, e))
            if to is None or last is not None and ts < last:
                refused += 1
                out.append((key[0], "REFUSED", i, "LATE" if to is not None else "ILLEGAL", state, number, refused))
                continue
            last = ts
            if (state, e) == ("AWAITING_CHAIR", "WEIGHTS") and number >= self.most:
                to = "SYNTHESIZING"
            number += to == "ROUND_ACTIVE" and state != "ROUND_ACTIVE"
            state = to
        self.now.update((state, int(number), int(refused), last))
        out.append((key[0], "STATE", None, None, state, number, refused))
        out = pd.DataFrame(out, columns=["debate_id", "kind", "event_id", "reason", "state", "round", "refused"])
        yield out.astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def debate_state(events: DataFrame, most_rounds: int = 3) -> DataFrame:
    """(debate_id, ts, event_id, event) -> rows of two kinds: STATE, the debate's state after each batch, and REFUSED, each event that was not applied, with the state it met."""
    return events.groupBy("debate_id").transformWithStateInPandas(_Debate(most_rounds), "debate_id long, kind string, event_id long, reason string, state string, round int, refused int", "append", "none")
