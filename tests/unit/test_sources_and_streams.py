"""Readers, sinks, and streams beside their batch versions."""

import json

import pytest
from pyspark.sql import functions as F

from attest.operators import contradictions as X
from attest.operators import views as W
from attest.sources import readers, sinks
from attest.streaming import jobs


@pytest.fixture
def stream(spark, tmp_path):
    """Rows as a stream of files, one a batch."""
    def make(batches, schema):
        folder = tmp_path / "in"
        folder.mkdir()
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part{k}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))

    return make


def _ran(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_text_files(spark, tmp_path):
    (tmp_path / "my_memo.md").write_text("Some text.\nMore.")
    (tmp_path / "empty.txt").write_text("  ")
    got = {r["title"]: r["reason"] for r in readers.text_docs(spark, str(tmp_path)).collect()}
    assert got == {"my memo": None, "empty": "EMPTY"}


def test_gold_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# gold\nrevenue = 4.2m or higher = 7\n\nno id\nx = y\nRevenue  = 4.2m or higher = 8\n")
    got = [(r["line_no"], r["query"], r["gold_chunk_id"], r["error"]) for r in readers.gold_retrieval(spark, str(tmp_path / "g.txt")).orderBy("line_no").collect()]
    assert got[0] == (2, "revenue = 4.2m or higher", 7, None)
    assert [g[3] for g in got[1:]] == ["NO_EQUALS_SIGN", "NOT_A_NUMBER", "REPEATED_QUERY"]
    (tmp_path / "e.tsv").write_text("# d\td\nm.md\tA\towns\tB\tA owns B.\nm.md\tA\tsings\tB\tA sings B.\n")
    assert [r["error"] for r in readers.gold_extraction(spark, str(tmp_path / "e.tsv")).collect()] == [None, "UNKNOWN_PREDICATE"]
    (tmp_path / "p.json").write_text(json.dumps({"documents": [{"document": "d", "sentences": [{"text": "s", "triples": [{"subject": "a", "predicate": "owns", "object": "b"}]}, {"text": "t", "expectNothing": True, "claims": [{"subject": "a", "polarity": "MAYBE"}]}]}]}))
    assert [(r["n_triples"], r["n_claims"], r["expect_nothing"], r["bad"]) for r in readers.gold_prose(spark, str(tmp_path / "p.json")).orderBy("no").collect()] == [(1, 0, False, False), (0, 1, True, True)]
    (tmp_path / "v.json").write_text(json.dumps({"items": [{"id": "1", "claimText": "c", "expectedVerdict": "SUPPORTED", "category": "x"}]}))
    assert readers.gold_verdicts(spark, str(tmp_path / "v.json")).first()["expected"] == "SUPPORTED"


def test_append_new_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "t"), ["k"])
    assert sinks.read_committed(spark, str(tmp_path / "t")).count() == 2


def test_a_batch_killed_before_its_commit_is_written_once(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    sinks.append_new(rows(1, 2), path, ["k"], 0)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(sinks, "commit", killed)
        sinks.append_new(rows(2, 3, 4), path, ["k"], 1)
    see = lambda: sorted(r["k"] for r in sinks.read_committed(spark, path).collect())
    assert see() == [1, 2]
    sinks.append_new(rows(2, 3, 4), path, ["k"], 1)
    assert see() == [1, 2, 3, 4]
    sinks.append_new(rows(2, 3, 4, 5), path, ["k"], 1)  # the batch is whole already
    assert see() == [1, 2, 3, 4] and sinks.committed(spark, path) == ["0", "1"]


def test_lines_that_cannot_be_read_are_kept(spark, tmp_path):
    lines = ['{"corpus_id":1,"reply_id":5,"raw_text":"{}"}', '{"corpus_id":1,"reply', "", "plain", '{"reply_id":6,"raw_text":"x"}', '{"corpus_id":2,"reply_id":7}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    got = {(r["corpus_id"], r["broken"] is None, r["raw_text"]) for r in readers.model_replies(spark, str(tmp_path / "r.json")).collect()}
    assert got == {(1, True, "{}"), (0, False, lines[1]), (0, False, "plain"), (0, False, '{"reply_id":6,"raw_text":"x"}'), (2, True, "")}
    assert readers.model_replies(spark, str(tmp_path / "r.json")).select("reply_id").distinct().count() == 5


def test_rate_limits_are_those_of_a_batch(spark, stream):
    batches = [[(1, 1, 0), (1, 2, 10), (1, 3, 50), (2, 4, 5)], [(1, 5, 100), (1, 6, 200), (2, 7, 65)], [(3, 8, 5000), (1, 9, 5001)], [(3, 10, 9000), (1, 11, 9001), (1, 12, 9001)]]
    kind = "user_id long, event_id long, s long"
    with jobs.state_store(spark):
        s = stream(batches, kind).withColumn("ts", F.timestamp_seconds(F.col("s") + 1))  # a watermark begins at 0
        got = {tuple(r) for r in _ran(jobs.rate_limit(s, 2), "rates", "append").collect()}
    calls = spark.createDataFrame([x for b in batches for x in b], kind).withColumn("ts", F.timestamp_seconds("s"))
    assert got == {(r["user_id"], r["event_id"], r["nth"], r["allowed"], r["remaining"]) for r in W.rate_nth_call(calls, 60, 2).collect()} and len(got) == 12


def test_stream_replies_are_kept_or_quarantined(spark, stream, tmp_path):
    good = '{"triples":[],"claims":[]}'
    s = stream([[(1, 1, good), (1, 2, "no")], [(1, 1, good), (1, 3, good)]], "corpus_id long, reply_id long, raw_text string")
    q = jobs.replies(s, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["reply_id"] for r in sinks.read_committed(spark, str(tmp_path / "good")).collect()) == [1, 3]
    assert [r["reason"] for r in sinks.read_committed(spark, str(tmp_path / "bad")).collect()] == ["MALFORMED_JSON"]


def test_stream_decisions_find_what_a_batch_finds(spark, stream, tmp_path):
    t = spark.createDataFrame([(1, k, f"s{k % 3}", "reports_to", f"o{k}", None, "PENDING") for k in range(9)], "corpus_id long, triple_id long, subject_text string, predicate string, object_text string, effective_time string, status string")
    s = stream([[(20 - k, k, "APPROVE", k) for k in range(9)] + [(1, 3, "REJECT", 99)]], "decision_id long, item_id long, decision string, decided_at long")  # the least id is not the earliest
    q = jobs.decisions(s, t, str(tmp_path / "f"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r[0] for r in sinks.read_committed(spark, str(tmp_path / "f")).select("conflict_hash").collect()}
    assert got == {r[0] for r in X.relation_conflicts(t).select("conflict_hash").collect()} and len(got) == 6


def test_conflicts_across_batches_are_found(spark, stream, tmp_path):
    t = spark.createDataFrame([(1, 1, "Tarn Quarry", "reports_to", "A", None, "PENDING"), (1, 2, "tarn quarry", "reports_to", "B", None, "PENDING"), (1, 3, "Tarn Quarry", "reports_to", "C", None, "PENDING")], "corpus_id long, triple_id long, subject_text string, predicate string, object_text string, effective_time string, status string")
    s = stream([[(1, 1, "APPROVE", 1), (2, 3, "REJECT", 2)], [(3, 2, "APPROVE", 3), (4, 3, "APPROVE", 4)]], "decision_id long, item_id long, decision string, decided_at long")
    q = jobs.decisions(s, t, str(tmp_path / "f"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = X.relation_conflicts(t.filter("triple_id < 3")).select("conflict_hash").collect()
    assert {r[0] for r in sinks.read_committed(spark, str(tmp_path / "f")).select("conflict_hash").collect()} == {r[0] for r in want} and len(want) == 1


def test_stream_counts(spark, stream):
    s = stream([[(0, "LLM", "OK"), (1, "LLM", "FAILED")], [(2, "ENGINE", "OK")], [(9000, "LLM", "OK")], [(19000, "LLM", "OK")]], "s long, actor_type string, status string").withColumn("ts", F.timestamp_seconds("s"))
    got = _ran(jobs.trace_stats(s, "10 minutes", "10 minutes"), "traces", "append").collect()
    assert {(r["actor_type"], r["n"], r["n_failed"]) for r in got} >= {("LLM", 2, 1), ("ENGINE", 1, 0)}


def test_stream_documents_and_what_is_stored(spark, stream):
    s = stream([[(1, "a", 0), (1, "a", 1), (2, "a", 1), (1, "c", 1)], [(1, "a", 2), (1, "b", 3), (1, "c", 4)]], "corpus_id long, text string, s long").withColumn("ts", F.timestamp_seconds("s"))
    stored = spark.createDataFrame([(1, "c"), (2, "b"), (1, "c")], "corpus_id long, text string").select("corpus_id", F.sha2("text", 256).alias("content_hash"))
    got = _ran(jobs.doc_dedup(s, stored), "dedup", "append").collect()
    assert sorted((r["corpus_id"], r["text"]) for r in got) == [(1, "a"), (1, "b"), (2, "a")]


def test_stream_run_progress_ends(spark, stream):
    s = stream([[(1, 0, 1), (1, 5, 2), (2, 7, 4)], [(1, 8, 8)], [(3, 900, 16)], [(3, 1900, 32)]], "run_id long, s long, n long").withColumn("ts", F.timestamp_seconds("s"))
    rows = s.select("run_id", "ts", *(F.col("n").alias(c) for c in ("processed", "triples", "claims", "quarantined")))
    got = _ran(jobs.run_progress(rows, "1 minute", "1 minute"), "runs", "append").collect()
    assert {(r["run_id"], r["processed"], r["quarantined"]) for r in got} >= {(1, 11, 11), (2, 4, 4)}


def test_stream_debates_end_as_in_a_batch(spark, stream):
    names = ["START", "ARGUED", "WEIGHTS", "DONE", "ARGUED", "WEIGHTS", "ARGUED", "WEIGHTS", "DONE"]
    ev = [(1, k, k, e) for k, e in enumerate(names)] + [(2, k, 100 + k, e) for k, e in enumerate(["ARGUED", "START", "START", "ARGUED"])]
    with jobs.state_store(spark):
        s = stream([ev[:4] + ev[9:11], ev[4:9] + ev[11:]], "debate_id long, at long, event_id long, event string").withColumn("ts", F.timestamp_seconds("at"))
        got = _ran(jobs.debate_state(s), "debates", "append").collect()
    frame = spark.createDataFrame(ev, "debate_id long, at long, event_id long, event string")
    want = {r["debate_id"]: (r["state"], r["round"], r["refused"]) for r in W.debate_fsm(frame).collect()}
    assert want[1] == ("COMPLETED", 3, 1)
    assert {d: max((r["round"], r["refused"], r["state"]) for r in got if r["kind"] == "STATE" and r["debate_id"] == d) for d in (1, 2)} == {d: (n, k, s) for d, (s, n, k) in want.items()}
    refused = {(r["debate_id"], r["event_id"], r["state"], r["round"]) for r in got if r["kind"] == "REFUSED"}
    assert refused == {tuple(r) for r in W.debate_refusals(frame).collect()} and len(refused) == 3


def test_late_events_of_a_debate_are_refused(spark, stream):
    with jobs.state_store(spark):
        s = stream([[(1, 10, 1, "START")], [(1, 5, 2, "ARGUED")], [(1, 11, 3, "ARGUED")]], "debate_id long, at long, event_id long, event string").withColumn("ts", F.timestamp_seconds("at"))
        got = _ran(jobs.debate_state(s), "late_debates", "append").filter("kind = 'REFUSED'").collect()
    assert [(r["event_id"], r["reason"], r["state"]) for r in got] == [(2, "LATE", "ROUND_ACTIVE")]


def test_stream_heartbeats(spark, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE)
    s = stream([[(1, 0), (2, 0)], [(1, 600)], [(2, 1100), (3, 1300)], [(3, 5000)], [(3, 9000)]], "job_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["job_id"], r["last_ms"]) for r in _ran(jobs.job_heartbeat(s), "silent", "append").collect()}
    assert {(1, 600_000), (2, 1_100_000)} <= got  # job 2 was heard again before its time was over
