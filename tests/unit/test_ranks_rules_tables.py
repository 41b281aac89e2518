"""Ranks by ranges, waves of labels, bounded retrieval, declared rules and table contracts, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from attest.operators import evaluation as E
from attest.operators import graph as G
from attest.operators import ranks
from attest.operators import retrieval as R
from attest.operators import rules
from attest.sources import tables


def test_numbers_by_ranges_are_row_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]) if k > 900 else "big", r.randrange(500), k) for k in range(2000)]
    got = ranks.numbered(spark.createDataFrame(rows, "g string, v int, k int"), ["g"], [F.desc("v"), "k"], "nth", "n").collect()
    for g in (None, "a", "b", "big"):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [(x["k"], x["nth"], x["n"]) for x in sorted((x for x in got if x["g"] == g), key=lambda x: x["nth"])] == [(k, i + 1, len(own)) for i, (_, _, k) in enumerate(own)]
    assert ranks.numbered(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


def _labels(edges, sweeps=8):
    """Label propagation node by node."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        else:
            near.setdefault(a, set())
    label = {k: k for k in sorted(near)}
    for _ in range(sweeps):
        before = dict(label)
        for k in label:
            count = {}
            for x in near[k]:
                count[label[x]] = count.get(label[x], 0) + 1
            label[k] = min(count, key=lambda x: (-count[x], x), default=label[k])
        if label == before:
            break
    first = {}
    for k, x in label.items():
        first.setdefault(x, k)
    number = {x: i for i, x in enumerate(sorted(first, key=first.get))}
    return {k: number[x] for k, x in label.items()}


@pytest.mark.parametrize("kind", ["path", "star", "giant"])
def test_waves_label_as_nodes_in_order(spark, kind):
    r = random.Random(4)
    edges = {"path": [(k, k + 1) for k in range(9)] + [(50, 50)], "star": [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(20, 30, 3)], "giant": [(r.randrange(60), 100 + r.randrange(200)) for _ in range(700)]}[kind]
    g = spark.createDataFrame([(1, a, "x", b) for a, b in edges], "corpus_id long, subject_id long, predicate string, object_id long")
    got = G.communities(g).collect()
    assert {x["node_id"]: x["community"] for x in got} == _labels(edges)
    names = spark.createDataFrame([(1, k, f"n{k}") for k in range(300)], "corpus_id long, node_id long, name string")
    members = G.community_members(spark.createDataFrame(got), names).collect()
    assert len(members) == len(got) and all(x["name"] == f"n{x['node_id']}" for x in members)
    nested = {x["community"]: (x["size"], x["members"]) for x in G.community_nested(spark.createDataFrame(got), names).collect()}
    for c, (n, own) in nested.items():
        assert own == sorted(x["node_id"] for x in got if x["community"] == c) and n == len(own)
        assert [x["node_id"] for x in sorted((x for x in members if x["community"] == c), key=lambda x: x["place"])] == own


def test_blocks_that_cannot_matter_are_left_out(spark):
    r = random.Random(7)
    words = [f"word{k}" for k in range(600)]
    chunks = [(c, k, " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(600)], k=r.randrange(2, 40)))) for c in (1, 2) for k in range(1500)]
    queries = [(c, q, " ".join(r.sample(words, 5))) for c in (1, 2) for q in range(12)] + [(1, 99, "nothing here"), (2, 98, "")]
    frame, asked = spark.createDataFrame(chunks, "corpus_id long, chunk_id long, content string"), spark.createDataFrame(queries, "corpus_id long, query_id long, query_text string")
    terms, words_ = R._postings(asked, frame, True)
    idf = F.log10(F.col("n_chunks") / F.col("df"))
    best, bound, left = R.best_of_blocks(terms, words_.withColumn("part", F.col("tf") * idf * idf), 5, 0.0, block=16)
    every, _, all_ = R.best_of_blocks(terms, words_.withColumn("part", F.col("tf") * idf * idf), 5, 0.0, block=10**9, seeds=1)
    key = lambda df: sorted((x["corpus_id"], x["query_id"], x["rank"], x["chunk_id"], x["score"]) for x in df.collect())
    assert key(best) == key(every) and len(key(best)) == 24 * 5
    assert left.count() < 0.8 * bound.count() and all_.count() == 24


def test_rules_of_every_kind(spark):
    a = spark.createDataFrame([(1, "x", 1, 5, 10, None), (2, "y", 7, 3, None, 3), (3, None, None, 9, 4, 4), (4, "x", 2, 5, None, None)], "id long, kind string, low int, high int, p int, q int")
    b = spark.createDataFrame([(1, 1), (2, 9), (3, None), (3, 2)], "b_id long, a_id long")
    declared = [
        ("a", "kind_known", "among", ("kind", ("x",))), ("a", "ordered", "before", ("low", "high")), ("a", "x_has_p", "implies", ("kind = 'x'", "p is not null")), ("a", "p_with_q", "both", ("p is null", "q is null")),
        ("a", "one", "one_of", ("p", "q")), ("a", "small", "between", ("high", 4, 8)), ("a", "plain", "check", ("low < 7",)), ("a", "kinds_differ", "unique", ("kind",)), ("b", "there", "refers", ("a_id", "a", "id")), ("b", "own_id", "unique", ("b_id",)),
        ("gone", "never", "check", ("false",)), ("b", "nowhere", "refers", ("a_id", "gone", "id")),
    ]
    got = sorted((x["table_name"], x["rule"], x["row_key"]) for x in rules.broken({"a": a, "b": b}, {"a": "id", "b": "b_id"}, declared).collect())
    assert got == sorted([("a", "kind_known", "2"), ("a", "ordered", "2"), ("a", "x_has_p", "4"), ("a", "p_with_q", "1"), ("a", "p_with_q", "2"), ("a", "one", "3"), ("a", "one", "4"), ("a", "small", "2"), ("a", "small", "3"), ("a", "plain", "2"), ("a", "kinds_differ", "x"), ("b", "there", "2"), ("b", "own_id", "3")])
    counts = {(x["table_name"], x["rule"]): x["n_broken"] for x in rules.audit({"a": a, "b": b}, {"a": "id", "b": "b_id"}, declared).collect()}
    assert len(counts) == 10 and counts["a", "one"] == 2 and rules.audit({"a": a.limit(0)}, {"a": "id"}, declared).filter("n_broken > 0").count() == 0


def test_a_table_that_breaks_its_contract_gives_reasons(spark, tmp_path):
    spark.createDataFrame([(1, "7"), (2, "x"), (2, None)], "k long, n string").write.parquet(str(tmp_path / "t"))
    rows, faults = tables.table(spark, str(tmp_path / "t"), "t", "k bigint not null, n bigint, lost string")
    assert sorted((x["column_name"], x["reason"]) for x in faults.collect()) == [("lost", "MISSING_COLUMN"), ("n", "WRONG_TYPE")]
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, 7, None), (2, None, None), (2, None, None)]
    assert {(x["column_name"], x["reason"], x["n"]) for x in tables.key_faults(rows, "t", "k bigint not null, n bigint", ["k"]).collect()} == {("k", "REPEATED_KEY", 1), ("k", "NULL_VALUE", 0)}
    rows, faults = tables.table(spark, str(tmp_path / "none"), "none", "k bigint")
    assert rows.count() == 0 and faults.first()["reason"] == "MISSING_TABLE"


def test_gold_is_claimed_once(spark):
    chunks = spark.createDataFrame([(1, 0, "Pell owns Reef. Moth rows.", "OK", 0), (1, 1, "Moth rows. Ida sells nets.", "OK", 0), (2, 0, "Tam owns Quay.", "FAILED", 0), (3, 0, "x", "MALFORMED", 0)], "doc_id long, chunk_index int, content string, outcome string, part int")
    fact = "doc_id long, subject string, predicate string, object string, sentence string"
    gold = spark.createDataFrame([(1, "Moth", "rows", "-", "Moth rows."), (1, "Ida", "sells", "nets", "Ida sells nets."), (2, "Tam", "owns", "Quay", "Tam owns Quay."), (1, "No", "where", "x", "Said by nobody.")], fact)
    said = spark.createDataFrame([(1, 0, "moth", "rows", "-"), (1, 1, "Moth", "rows", "-"), (1, 1, "Ida", "sells", "Nets!"), (2, 0, "Tam", "owns", "Quay")], "doc_id long, chunk_index int, subject string, predicate string, object string")
    got = E.extraction_report(gold, said, chunks, ["part"]).first()
    assert (got["tp"], got["fp"], got["fn"], got["n_unplaced"], got["n_failed"], got["malformed_rate"]) == (2, 1, 1, 1, 1, 0.25)
