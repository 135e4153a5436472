"""Splits, ranking, components, lint, passages and nearest examples against brute force."""

import datetime
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertloom.operators import automaton
from alertloom.operators import components as cc
from alertloom.operators import lexical as lx
from alertloom.operators import lint
from alertloom.operators import splits as sp
from alertloom.operators.ranking import hashed_position
from alertloom.operators.textmatch import passages_in_text, terms_in_text
from alertloom.plans import registry
from alertloom.session import cut_lineage
from alertloom.sources import fingerprint as fp
from alertloom.sources import readers as rd
from alertloom.sources import writers as wr


def spaced(n):
    k = int(n * 0.15 + 0.5)
    out = ["train"] * n
    for name, offset in (("test", 0.25), ("val", 0.75)):
        for j in range(k):
            i = int((j + offset) * n / k) % n
            assert out[i] == "train"
            out[i] = name
    return out


@pytest.mark.parametrize("n", [1, 3, 4, 7, 20, 101, 1003])
def test_stratified_positions(spark, n):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 2).alias("s"))
    got = {r["index"]: r.new_split for r in sp.stratified_split(df, ["s"], "id").collect()}
    assert [got[i] for i in range(n)] == spaced(n)


def test_positions_are_a_permutation_whatever_the_partitions(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    a = {r.id: (r.k, r.position, r.group_size) for r in hashed_position(df.repartition(3), ["k"], "id", 1).collect()}
    b = {r.id: (r.k, r.position, r.group_size) for r in hashed_position(df.repartition(11), ["k"], "id", 1).collect()}
    assert a == b
    hot = sorted(p for k, p, _ in a.values() if k == "hot")
    assert hot == list(range(len(hot)))


def test_family_pools(spark):
    df = spark.createDataFrame([("p", f"f{i}") for i in range(10)], "pool string, family string")
    got = Counter(r.split for r in sp.family_pool_split(df, "pool", "family").collect())
    assert got == {"train": 6, "val": 2, "test": 2}
    with pytest.raises(PySparkException):
        sp.family_pool_split(df.limit(2), "pool", "family").collect()


def test_grouped_shuffle_keeps_groups_together(spark):
    df = spark.range(200).select("id", (F.col("id") % 40).alias("g"), F.lit("train").alias("split"))
    order = [r.g for r in sp.grouped_shuffle(df, "split", "g", "id").collect()]
    assert len([i for i in range(1, 200) if order[i] != order[i - 1]]) == 39 and order != sorted(order)


def brute_groups(links):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, t in links:
        parent[top(("t", t))] = top(("p", p))
    members = {}
    for p, _ in links:
        members.setdefault(top(("p", p)), set()).add(p)

    def joined(parts):
        return hashlib.sha256("|".join(sorted(parts)).encode()).hexdigest()

    def group_id(pairs):
        leaves, tops = {}, {}
        for p in pairs:
            leaves.setdefault(hashlib.md5(p.encode()).hexdigest()[:4], []).append(p)
        for k, leaf in leaves.items():
            tops.setdefault(k[:2], []).append(joined(leaf))
        return "G-" + joined([joined(v) for v in tops.values()])[:10]

    return {p: group_id(m) for m in members.values() for p in m}


def test_components_chain_hub_and_islands(spark):
    rng = random.Random(5)
    links = [(f"a{i}", f"x{i // 2}") for i in range(60)] + [(f"a{2 * i + 1}", f"x{i + 1}") for i in range(25)]  # a long chain
    links += [(f"h{i}", "hub") for i in range(200)] + [(f"i{i}", f"y{i}") for i in range(20)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "pair_id string, template_family string")
    assert {r.pair_id: r.group_id for r in cc.group_components(df).collect()} == brute_groups(links)


def test_large_component_ids_are_stable(spark):
    links = [(f"h{i}", "hub") for i in range(50)]
    a = {r.group_id for r in cc.group_components(spark.createDataFrame(links, "pair_id string, template_family string")).collect()}
    b = {r.group_id for r in cc.group_components(spark.createDataFrame(links[::-1], "pair_id string, template_family string")).collect()}
    assert len(a) == 1 and a == b


def test_pairs_of_one_family_need_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(cc, "_large_star", lambda edges, step=cc._large_star: rounds.append(1) or step(edges))
    links = [(1, 7), (2, 7), (10, 7), (3, 8), (4, None), (5, None), (None, 7), (None, 8), (1, 7)]
    got = {r.pair_id: r.group_id for r in cc.group_components(spark.createDataFrame(links, "pair_id long, template_family long")).collect()}
    assert got == brute_groups([(str(p), f"f{f}" if f else f"own{p}") for p, f in links if p])
    assert not rounds


def test_chains_of_whole_numbers(spark):
    links = [(i, i // 2) for i in range(0, 40)] + [(i + 1, i // 2) for i in range(1, 39, 4)] + [(-5, 0), (100, 99)]
    got = {r.pair_id: r.group_id for r in cc.group_components(spark.createDataFrame(links, "pair_id long, template_family int")).collect()}
    assert got == brute_groups([(str(p), f"f{f}") for p, f in links])


def test_lint_joins_the_cases_once(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), i % 3, "error", 5.0 * i, "{}") for i in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    out = registry.queries()["v14_dataset_lint"](spark, str(tmp_path))
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").splitlines()
    assert sum("user_id#" in x for x in leaves) <= 5  # events, changes and incidents of the nested cases
    assert {"leak_template_family", "leak_group", "label_recheck"} <= {r.rule for r in out.select("rule").distinct().collect()}


def test_rows_without_a_finding_are_not_listed(spark):
    full = dict(
        case_id=1, cohort="A", split="train", pair_id=1, template_family=1, dataset_kind="derived", seed_source="s", template_id="t", wrapper_family="none",
        slang_term=None, provenance="p", raw="all well, 192.0.2.7, 300.1.1.1", window=["fine"], label_status="rubric_derived", label_version="2.4.0",
        has_label=True, has_expected=True, label_page_now=False,
    )
    cases = [{}, dict(split=None), dict(raw="at 8.8.8.8"), dict(window=["Page_Now"]), dict(window=["Page_Now"], cohort=None), dict(raw="Term", split="val"), dict(template_id=None), dict(cohort="B_prime", raw=None)]
    kinds = "case_id int, cohort string, split string, pair_id int, template_family int, dataset_kind string, seed_source string, template_id string, wrapper_family string, slang_term string, provenance string, raw string, window array<string>, label_status string, label_version string, has_label boolean, has_expected boolean, label_page_now boolean"
    names = [k.split()[0] for k in kinds.split(", ")]
    df = spark.createDataFrame([tuple((full | c | {"case_id": i})[n] for n in names) for i, c in enumerate(cases)], kinds)
    got = sorted((r.key, r.rule, r.detail) for r in lint.row_rules(df, "derived", [("term", "train")]).collect())
    assert got == [
        ("1", "missing_split", "split"), ("1", "unknown_split", "null"), ("2", "foreign_ip", "8.8.8.8"), ("3", "answer_in_text", "3"),
        ("5", "lexicon_term", "term"), ("6", "missing_template_id", "template_id"), ("7", "b_prime_lost_page", "B_prime"), ("7", "b_prime_without_claim", "B_prime"),
    ]


def test_leaks_ignore_null_and_none(spark):
    rows = [("train", "p1", "none", None), ("test", "p1", "none", None), ("val", "p2", "W", "s"), ("val", "p2", "W", "s")]
    df = spark.createDataFrame(rows, "split string, pair_id string, wrapper_family string, slang_term string")
    got = [tuple(r) for r in lint.leaks(df, ("pair_id", "wrapper_family", "slang_term")).collect()]
    assert got == [("leak_pair_id", "p1", "train,test")]


def test_passages_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, "Intro, " + " ".join(rng.choices(words, k=40)) + ". End") for i in range(60)]
    passages = []
    for j in range(30):
        t = rng.choice(texts)[1]
        a = rng.randrange(0, len(t) - 40)
        passages.append((j, t[a:a + rng.randrange(24, 40)].upper()))
    passages = [p for p in passages if len(re.findall("[a-z0-9]+", p[1].lower())) >= 5] + [(99, "this is not in any text")]
    got = {tuple(r) for r in passages_in_text(spark.createDataFrame(texts, "d long, t string"), "d", "t", spark.createDataFrame(passages, "p long, q string"), "p", "q").collect()}
    assert got == {(d, p) for d, t in texts for p, q in passages if q.lower() in t.lower()} and got


def test_automaton_against_brute_force(monkeypatch):
    monkeypatch.setattr(automaton, "LANE", 5)
    rng = random.Random(9)
    for letters in ("ab", "abcdé", "".join(map(chr, range(1, 300)))):
        draw = lambda n, letters=letters: "".join(rng.choices(letters, k=n)).encode()
        terms = list({draw(rng.randrange(1, 9)) for _ in range(60)})
        texts = [draw(rng.choice([0, 1, 7, 40, 400])) for _ in range(50)] + [b"".join(terms)]
        offsets = np.cumsum([0, *map(len, texts)])
        got = automaton.Automaton(terms).run(np.frombuffer(b"".join(texts), np.uint8), offsets)
        assert set(zip(*(g.tolist() for g in got), strict=True)) == {(i, k) for i, t in enumerate(texts) for k, x in enumerate(terms) if x in t}
        ranges = automaton.cut_terms(terms, 400)
        assert sorted(k for r in ranges for k in r) == list(range(len(terms))) and len(ranges) > 1


def test_terms_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choices(["Ab", "bca", " ", "abcd", "d e", "é.x", "\n", "Ü"], k=rng.choice([0, 3, 30, 900])))) for i in range(60)] + [(3, "ab twice"), (98, ""), (99, None), (None, "ab")]
    terms = [(0, "ab bc"), (1, "A"), (2, "ca"), (3, "é.X"), (4, "not here"), (5, ""), (6, "\n"), (7, None), (8, "bca"), (9, "BCA"), (None, "abcd"), (10, "ü" * 3)]
    t, p = spark.createDataFrame(texts, "d long, t string"), spark.createDataFrame(terms, "p long, q string")
    want = sorted((str(d), str(k)) for d, x in texts for k, q in terms if x and q and q.lower() in x.lower())
    rows = lambda: sorted((str(r.d), str(r.p)) for r in terms_in_text(t, "d", "t", p, "p", "q").collect())
    assert rows() == want and want
    monkeypatch.setattr(automaton, "TABLE_BYTES", 300)  # several automata, one pass
    assert rows() == want
    monkeypatch.setattr(automaton, "SENT_BYTES", 100)  # too much to send
    assert automaton.scan(t, "d", "t", p, "p", "q") is None
    assert {r for r in rows() if "None" not in r} == {r for r in want if "None" not in r}
    assert terms_in_text(t, "d", "t", p.limit(0), "p", "q").count() == 0 and terms_in_text(t.limit(0), "d", "t", p, "p", "q").count() == 0


def test_short_passages_against_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["Ab", "bca", "c", "abcd", "d e", "é.x", "\n"], k=rng.randrange(0, 30)))) for i in range(80)] + [(98, ""), (99, None)]
    passages = [(0, "ab bc"), (1, "A"), (2, "ca c"), (3, "é.x ab"), (4, "not here"), (5, ""), (6, "\n"), (7, "abcd c ab c"), (8, "bca"), (9, "bca"), (10, "zz")]
    got = [tuple(r) for r in passages_in_text(spark.createDataFrame(texts, "d long, t string"), "d", "t", spark.createDataFrame(passages, "p long, q string"), "p", "q").collect()]
    assert len(got) == len(set(got)) and set(got) == {(d, p) for d, t in texts for p, q in passages if q and t and q.lower() in t.lower()} and got


def brute_nearest(train, query):
    bags = [(o, Counter(re.findall("[a-z0-9]+", t.lower()))) for o, t in train]
    n, df = len(bags), Counter(w for _, b in bags for w in b)
    avg = sum(sum(b.values()) for _, b in bags) / n
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    best = None
    for o, b in bags:
        dl = sum(b.values())
        s = sum(idf[w] * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * dl / avg)) for w in re.findall("[a-z0-9]+", query.lower()) if w in b)
        if best is None or round(s, 9) > best[1]:
            best = (o, round(s, 9))
    return best


@pytest.mark.parametrize("task_rows", [50, 400_000])
def test_nearest_example_against_brute_force(spark, monkeypatch, task_rows):
    """Common words, exact copies on both sides, a query of unknown words and an empty one; many shards or one."""
    monkeypatch.setattr(lx, "TASK_ROWS", task_rows)
    rng = random.Random(7)
    words = ["the", "of"] + [f"word{i}" for i in range(60)]
    weights = [60, 40] + [60 / (i + 1) for i in range(60)]
    text = lambda: " ".join(rng.choices(words, weights, k=rng.randrange(3, 30)))
    train = [(i, text()) for i in range(80)]
    train += [(80 + i, train[5][1]) for i in range(30)]  # a third are copies
    queries = [(1000 + i, text()) for i in range(40)] + [(2000, train[5][1]), (2001, train[5][1].upper()), (2002, "zzz qqq"), (2003, "")]
    t = spark.createDataFrame([(i, s, i % 2) for i, s in train], "id long, text string, y long")
    q = spark.createDataFrame(queries, "qid long, text string")
    got = {r.qid: (r.rep, round(r.score, 6), r.target) for r in lx.nearest(q, "qid", "text", t, "id", "text", "id", "y").collect()}
    for qid, s in queries:
        rep, score = brute_nearest(train, s)
        assert got[qid] == (rep, round(score, 6), rep % 2), (qid, s)


def test_no_rows_between_queries_and_labeled_texts(spark, monkeypatch):
    """What is written and shuffled is one list of words for each text, however many blocks the other side has."""
    made = []
    monkeypatch.setattr(lx, "cut_lineage", lambda df: made.append(cut_lineage(df)) or made[-1])
    counts = []
    monkeypatch.setattr(lx, "release", lambda *stages: counts.extend((s.columns, s.count()) for s in stages))
    monkeypatch.setattr(lx, "TASK_ROWS", 40)
    monkeypatch.setattr(lx, "SHARD_ROWS", 40)
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(["the", "of", "to"] + [f"w{i}" for i in range(40)], k=12))
    t = spark.createDataFrame([(i, text(), i) for i in range(120)], "id long, text string, y long")
    q = spark.createDataFrame([(i, text()) for i in range(120)], "qid long, text string")
    assert lx.nearest(q, "qid", "text", t, "id", "text", "id", "y").count() == 120
    blocks = [n for names, n in counts if "starts" in names]
    assert len(blocks) == 2 and min(blocks) >= 20
    assert max(n for _, n in counts) <= 120 * 12


def test_sums_that_nearly_tie_are_told_apart():
    """Many texts of nearly the same score: single precision finds the candidates, double precision the best; the first of equals."""
    rng = np.random.default_rng(5)
    words, texts, asked = 400, 300, 20
    weights = np.repeat(1.0 + rng.random(words)[None], texts, 0) + rng.integers(0, 3, (texts, words)) * 1e-8
    weights[200] = weights[100]

    def block(values):
        n = len(values)
        return {"starts": np.arange(n + 1) * words, "names": np.arange(words) * 7, "at": np.tile(np.arange(words), n), "weights": values.ravel()}

    tf = rng.integers(1, 9, (asked, words)).astype(float)
    want = np.round(tf @ weights.T, lx.DIGITS)
    best, score = lx._best_of(block(tf), block(weights))
    assert np.allclose(score, want.max(1), rtol=0, atol=3e-9) and np.allclose(want[np.arange(asked), best], want.max(1), rtol=0, atol=3e-9)
    assert (best != 200).all()


@pytest.mark.parametrize("most_dense", [0, 5, 2048])
def test_blocks_word_by_word_against_brute_force(monkeypatch, most_dense):
    """Words of all frequencies, some on one side only, in the product or not; a floor leaves out what is worse and keeps a tie."""
    monkeypatch.setattr(lx, "MOST_DENSE", most_dense)
    monkeypatch.setattr(lx, "GATHERED", 1000)
    rng = np.random.default_rng(11)
    share = np.array([0.9, 0.7, 0.5, 0.5, 0.3, 0.2] + [0.02] * 60 + [0.002] * 200)

    def side(texts, values, first, last):
        has = (rng.random((texts, len(share))) < share) & (np.arange(len(share)) >= first) & (np.arange(len(share)) < last)
        table = np.where(has, values((texts, len(share))), 0.0)
        row, word = np.nonzero(has)
        names, at = np.unique(word, return_inverse=True)
        return table, lx._turned(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=texts))]), names * 5, at, table[row, word])

    tf, q = side(600, lambda n: rng.integers(1, 5, n).astype(float), 0, 250)
    weights, d = side(150, lambda n: rng.integers(1, 9, n) / 4, 3, 266)
    want = tf @ weights.T
    top = want.max(1)
    best, score = lx._meet(q, d, np.zeros(600))
    assert (score == top).all() and (best == np.where(top > 0, want.argmax(1), 0)).all()
    floor = top + np.arange(600) % 3 - 1
    best, score = lx._meet(q, d, np.maximum(floor, 0))
    assert (score == np.where(np.arange(600) % 3 == 2, 0, top)).all()


def test_blocks_go_to_python_as_bytes(spark, monkeypatch):
    """Words of a block are no list of values, which would be copied one by one for every pair of blocks; only bests go on."""
    made, scored = [], []
    monkeypatch.setattr(lx, "cut_lineage", lambda df: made.append(df.schema) or cut_lineage(df))
    score = lx._score
    monkeypatch.setattr(lx, "_score", lambda *args: scored.append(cut_lineage(score(*args))) or scored[-1])
    monkeypatch.setattr(lx, "TASK_ROWS", 20)
    monkeypatch.setattr(lx, "SHARD_ROWS", 20)
    monkeypatch.setattr(lx, "BLOCKS", 1000)
    t = spark.createDataFrame([(i, f"a b w{i}", i) for i in range(60)], "id long, text string, y long")
    q = spark.createDataFrame([(100, "a b w7"), (101, "w9 a")], "qid long, text string")
    got = {r.qid: r.rep for r in lx.nearest(q, "qid", "text", t, "id", "text", "id", "y").collect()}
    assert got == {100: 7, 101: 9}
    blocks = [s for s in made if "starts" in s.names]
    assert len(blocks) == 2 and all(s[f].dataType.simpleString() == "binary" for s in blocks for f in ("names", "starts", "rows", "weights"))
    assert sum(r.score >= 2 for r in scored[0].collect()) == 2


def test_kinds_with_the_same_examples_are_searched_once(spark, monkeypatch):
    searched = []
    search = lx._search
    monkeypatch.setattr(lx, "_search", lambda *args: searched.append(1) or search(*args))
    texts = [(1, "disk full on db"), (2, "login failed twice"), (3, "all quiet"), (4, "alpha beta"), (5, "gamma delta")]
    train = [(i, s, k, y) for i, s in texts for k, y in (("choice", f"t{i}"), ("noul", str(i % 2)))]
    calls = [(i, s, task, kind, ["t1", "t2", "t3"]) for i, s in [(11, "disk of db is full"), (12, "login failed"), (13, "nothing")] for task, kind in (("event_type", "choice"), ("page_now", "noul"))]
    c = spark.createDataFrame(calls, "case_id long, state string, task string, kind string, options array<string>")

    def rows(examples):
        t = spark.createDataFrame(examples, "case_id long, state string, kind string, target string")
        return {(r.case_id, r.task): (r.value_type, r.value_page) for r in lx.nearest_outcomes(c, t).collect()}

    want = {(11, "event_type"): ("t1", None), (12, "event_type"): ("t2", None), (13, "event_type"): ("t1", None), (11, "page_now"): (None, True), (12, "page_now"): (None, False), (13, "page_now"): (None, True)}
    assert rows(train) == want and len(searched) == 1
    # one example less of one kind, and each kind has its own index again
    assert rows(train[:-1]) == want and len(searched) == 3
    assert rows([r for r in train if r[:3] != (2, "login failed twice", "noul")]) == want | {(12, "page_now"): (None, True)} and len(searched) == 5


def test_splits_round_trip_and_context_rules(spark, tmp_path):
    from alertloom.plans import files

    path = str(tmp_path / "cases")
    stored = files._stored_cases(spark, "/root/testdata/sf0.001")
    wr.write_splits(stored, path)
    back = rd.read_cases(spark, path, ("train", "val", "test"))
    assert back.count() == stored.count() and rd.quarantined(back).count() == 0 and rd.context_errors(back).count() == 0
    with pytest.raises(ValueError):
        rd.read_cases(spark, path, ("holdout",))
    bad = str(tmp_path / "bad" / "split=val")
    spark.createDataFrame([("{not json",)], "value string").write.text(bad)
    assert rd.quarantined(rd.read_cases(spark, str(tmp_path / "bad"), ("val",))).count() == 1


def test_registry_and_csv_readers_refuse_bad_rows(spark, tmp_path):
    p = str(tmp_path / "r")
    spark.createDataFrame([('{"source":"s","template_id":"t"}',)], "value string").write.text(p)
    with pytest.raises(PySparkException):
        rd.read_templates_jsonl(spark, p).collect()
    c = str(tmp_path / "c.csv")
    with open(c, "w") as f:
        f.write('EventId,EventTemplate\nE1,"a, <*> b"\n')
    assert [tuple(r) for r in rd.read_template_csv(spark, c).collect()] == [("E1", "a, <*> b")]
    with open(c, "w") as f:
        f.write("Id,EventTemplate\nE1,a\n")
    with pytest.raises(ValueError):
        rd.read_template_csv(spark, c)


def test_fingerprints(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    r = fp.file_fingerprints(spark, str(tmp_path / "f")).first()
    assert (r.file, r.bytes, r.sha256) == ("a.txt", 3, hashlib.sha256(b"abc").hexdigest())
    df = spark.range(1000)
    assert fp.table_fingerprint(df.repartition(3)).first() == fp.table_fingerprint(df.repartition(9)).first()
    listed = spark.createDataFrame([("a.txt", 4), ("b.txt", 1)], "file string, bytes long")
    got = sorted(tuple(x) for x in fp.verify_manifest(listed, fp.file_fingerprints(spark, str(tmp_path / "f"))).collect())
    assert got == [("a.txt", "bytes does not match manifest"), ("b.txt", "listed in manifest but missing")]
    with pytest.raises(ValueError):
        fp.require_clean(spark.createDataFrame(got, "file string, problem string"))


def test_files_of_any_kind_are_hashed_as_they_are(spark, tmp_path):
    rng = random.Random(1)
    bodies = {"empty": b"", "feeds": b"\n\n\n", "open end": b"a\nb", "crlf.txt": b"x\r\ny\r\n", "long line": b"z" * 300_000 + b"\n", "plus+%20 ü": b"1", "random.bin": rng.randbytes(200_000), "deep/inside": rng.randbytes(5000) + b"\n"}
    bodies |= {f"many/{i}": f"line {i}\n".encode() * (i + 1) for i in range(60)}
    for name, body in bodies.items():
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # the session's own splits do not matter
    try:
        rows = fp.file_fingerprints(spark, str(tmp_path / "data")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.sha256, r.bytes) for r in rows) == sorted((hashlib.sha256(b).hexdigest(), len(b)) for b in bodies.values() if b)


def test_many_small_files_share_a_task(spark, tmp_path, monkeypatch):
    bodies = [f"line {i}\n".encode() * (i % 7 + 1) for i in range(200)]
    for i, body in enumerate(bodies):
        (tmp_path / "data" / f"page={i}").mkdir(parents=True)
        (tmp_path / "data" / f"page={i}" / "a.txt").write_bytes(body)
    made = []
    monkeypatch.setattr(fp, "work_path", lambda s, label: made.append(str(tmp_path / label)) or made[-1])
    rows = fp.file_fingerprints(spark, str(tmp_path / "data")).collect()
    assert sorted(r.sha256 for r in rows) == sorted(hashlib.sha256(b).hexdigest() for b in bodies)
    stored = spark.read.parquet(made[0])
    assert stored.select("_metadata.file_path").distinct().count() <= 2 * spark.sparkContext.defaultParallelism  # a file of each task


def test_only_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Small files are hashed without being opened as text; large ones, whatever is in them, still as they stream by."""
    rng = random.Random(2)
    bodies = {"small": b"a\nb", "edge": b"y" * 1000, "feeds": b"\n" * 3000, "random": rng.randbytes(50_000), "open end": b"line\n" * 4000 + b"end", "long": b"z" * 5000 + b"\n"}
    for name, body in bodies.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_bytes(body)
    monkeypatch.setattr(fp, "SMALL_BYTES", 1000)
    streamed, large = fp._streamed, []
    monkeypatch.setattr(fp, "_streamed", lambda *args: large.append(streamed(*args)) or large[-1])
    got = {r.path.split("/")[-2]: (r.sha256, r.bytes) for r in fp.file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items()}
    assert len(large) == 1 and large[0].count() == 4
    monkeypatch.setattr(fp, "SMALL_BYTES", 1 << 20)
    assert fp.file_fingerprints(spark, str(tmp_path)).count() == 6 and len(large) == 1


def test_texts_are_files_of_their_keys(spark, tmp_path):
    """One whole file for a key of a partition, nothing beside it (no checksum files, whose rights cost a process each)."""
    rows = [(1, "a"), (2, "b\nc"), (2, "b\nc"), (3, None), (None, "x"), (-4, "ü"), (5, "")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    path = str(tmp_path / "out")
    wr.write_texts(df.repartition(3, "page_id"), path, "page_id", "html")
    got = {}
    for folder, _, names in os.walk(path):
        if names:
            assert len(names) == 1 and names[0].startswith("part-")
            with open(os.path.join(folder, names[0]), "rb") as f:
                got[os.path.basename(folder)] = f.read()
    assert got == {"page_id=1": b"a\n", "page_id=2": b"b\nc\nb\nc\n", "page_id=3": b"\n", "page_id=__HIVE_DEFAULT_PARTITION__": b"x\n", "page_id=-4": "ü\n".encode(), "page_id=5": b"\n"}
    # other keys have Spark's writer, which spells them so that they can be folders
    wr.write_texts(df.select(F.lit("a/b").alias("k"), "html"), str(tmp_path / "other"), "k", "html")
    assert "k=a%2Fb" in os.listdir(tmp_path / "other")
    # an empty table has a folder all the same
    wr.write_texts(df.where("page_id = 9"), str(tmp_path / "none"), "page_id", "html")
    assert os.path.isdir(tmp_path / "none")


def test_no_split_file_holds_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wr, "FILE_ROWS", 10)
    cases = spark.range(95).select(F.lit("train").alias("split"), F.lit("A").alias("cohort"), F.col("id").alias("case_id"))
    wr.write_splits(cases, str(tmp_path / "c"))
    back = spark.read.json(str(tmp_path / "c")).groupBy("_metadata.file_path").count()
    assert back.agg(F.sum("count"), F.max("count") <= 10).first() == (95, True)


def test_set_digest_tells_rows_apart(spark):
    digest = lambda rows: fp.set_digest(spark.createDataFrame(rows, "a string, b string"), "a", "b").first().digest
    base = [("x|", "y"), ("p", None)]
    assert digest(base) == digest(base[::-1])
    others = [[("x", "|y"), ("p", None)], [("x|", "y"), ("p", "")], [("x|", "y"), ("p", "n")], base + base[:1], base[:1], []]
    assert len({digest(base), *map(digest, others)}) == 7


def test_every_string_is_found(spark):
    df = spark.createDataFrame([(("a", [("b", ["c", None]), None], {"k": "v"}, 3), None)], "s struct<x:string,l:array<struct<y:string,z:array<string>>>,m:map<string,string>,n:int>, t struct<q:string>")
    assert sorted(df.select(lint.all_strings(df, "s", "t").alias("found")).first().found) == ["a", "b", "c", "k", "v"]


def test_reports_refuse_non_finite_numbers(spark, tmp_path):
    with pytest.raises(PySparkException):
        wr.write_report_tables({"t": spark.createDataFrame([(float("nan"),)], "x double")}, str(tmp_path / "r"))
