"""Batch scoring, scenario intervals, chat gates and rendering, against the row form or plain Python."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import bootstrap as bs
from alertloom.operators import rendering as rd
from alertloom.operators import scorecard as sc
from alertloom.operators import scoring as so

CALL = "case_id long, task string, options array<string>, state string, target string"


def calls(spark, n=300):
    rows = [(i, ("event_type", "page_now", "priority")[i % 3], ["a", "b"], f"s{i}", "secret") for i in range(n)]
    return spark.createDataFrame(rows, CALL).repartition(3)


def scorer():
    """A function made inside another travels to the workers by value."""

    def one(call):
        assert "target" not in call
        i = call["case_id"]
        if i % 11 == 0:
            raise so.Unsupported("not this one")
        if i % 13 == 0:
            raise so.SchemaFailure("odd")
        if i % 17 == 0:
            raise RuntimeError("down")
        return {"event_type": {"choice": "a", "choice_probs": {"a": 0.75, "b": 0.25}}, "page_now": {"prob": i / 300}, "priority": {"score": float(i % 101)}}[call["task"]]

    return one


def test_batches_give_what_rows_give(spark):
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    one = scorer()
    want = rows(so.batch_score(calls(spark), "m", one, supported=("event_type", "page_now", "priority")))
    for size in (1, 7, 1024):
        got = so.batch_score_arrow(calls(spark), "m", lambda: lambda batch: [one(c) for c in batch.to_pylist()], rows=size)
        assert rows(got) == want
    part = so.batch_score_arrow(calls(spark), "m", lambda: lambda batch: [one(c) for c in batch.to_pylist()], supported=("page_now",))
    assert part.where("status = 'unsupported'").count() >= 200


def test_the_scorer_is_made_once_in_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda batch: [{"choice": "a", "prob": 0.5, "score": 1.0}] * len(batch)

    for _ in range(2):
        assert so.batch_score_arrow(calls(spark).repartition(24), "m", make, rows=5).where("status = 'ok'").count() == 300
    made = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(made) == len(set(made)) < 24


def test_wrong_number_of_results_is_found(spark):
    got = so.batch_score_arrow(calls(spark, 30), "m", lambda: lambda batch: [{"choice": "a", "prob": 0.5, "score": 1.0}] * (len(batch) - 1))
    assert {(r.status, r.error) for r in got.collect()} == {("schema_failure", "0 results for 1 calls")}


def test_scenario_intervals(spark):
    rng = random.Random(2)
    rows = [("a", "b", rng.choice(["m1", "m2"]), f"s{rng.randrange(3)}", f"c{rng.randrange(25)}", rng.uniform(-1, 1)) for _ in range(400)] + [("a", "b", "m1", "alone", "c1", 0.5)]
    df = spark.createDataFrame(rows, "a string, b string, metric string, scenario string, cluster string, diff double").repartition(5)
    got = {(r.metric, r.scenario): r for r in bs.scenario_bootstrap(df, n_boot=150).collect()}
    weight = lambda rep, c: sum(b <= int(hashlib.md5(f"42:{rep}:{c}".encode()).hexdigest()[:8], 16) for b in bs.POISSON_BOUNDS)
    for key in {(r[2], r[3]) for r in rows}:
        own = [r for r in rows if (r[2], r[3]) == key]
        clusters = {r[4] for r in own}
        r = got[key]
        assert (r.n, r.n_clusters) == (len(own), len(clusters)) and r.diff == pytest.approx(sum(x[5] for x in own) / len(own), abs=1e-6)
        if len(clusters) < 2:
            assert r.ci_low is None and "two clusters" in r.na_reason
            continue
        means = sorted(sum(weight(k, x[4]) * x[5] for x in own) / w for k in range(150) if (w := sum(weight(k, x[4]) for x in own)))
        at = lambda q: means[int(q)] + (means[min(int(q) + 1, len(means) - 1)] - means[int(q)]) * (q - int(q))
        assert (r.ci_low, r.ci_high) == (pytest.approx(at(0.025 * (len(means) - 1)), abs=2e-6), pytest.approx(at(0.975 * (len(means) - 1)), abs=2e-6))


def test_chat_gates_of_candidates_without_rows(spark):
    names = spark.createDataFrame([("x",), ("y",)], "candidate string")
    chat = spark.createDataFrame([("x", "must_page_recall", 1000, 1000)], "candidate string, metric string, num long, den long")
    got = {(r.candidate, r.gate): r.status for r in sc.chat_gates(names, chat).collect()}
    assert got == {("x", "chat_must_page_recall_min"): "pass", ("x", "chat_spoof_recall_min"): "not_evaluated", ("y", "chat_must_page_recall_min"): "not_evaluated", ("y", "chat_spoof_recall_min"): "not_evaluated"}
    assert sc.chat_gates(names, chat, enabled=False).count() == 0


def test_rendered_keys_are_in_order(spark):
    df = spark.sql("SELECT named_struct('format', 'f', 'raw', 'r', 'host', 'h', 'service', null, 'signal', 's', 'ts', timestamp'2024-01-01', 'window', array('w1', 'w2')) AS event, named_struct('z', array(named_struct('b', 1, 'a', array(named_struct('d', 2, 'c', 3)))), 'y', cast(null AS struct<q:int>)) AS context, 'label' AS label")
    text = df.select(rd.render_state(df.schema).alias("t")).first().t
    assert text == 'EVENT format=f\nr\nw1\nw2\nEVENT FIELDS {"host":"h","signal":"s","ts":"2024-01-01T00:00:00Z"}\nCONTEXT {"z":[{"a":[{"c":3,"d":2}],"b":1}]}'
    assert df.select(F.col("label")).first().label not in text
