"""Classifier, centroid clustering and collocations, against brute force in plain Python and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from alertloom.llm import collocations, partials, phrase_automata, quality_svm, queries, rotated_means
from alertloom.llm.common import find_package

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Classifier


def plain_features(text):
    """n-grams of words and of shapes, as the docstring of the module says, without hashing."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = [lower(w) for w in words]
    shapes = []
    for k, w in enumerate(words):
        signs = "".join("A" if b in range(65, 91) else "a" if b in range(97, 123) or b >= 128 else "0" if b in range(48, 58) else chr(b) for b in w.encode())
        shapes.append("=same" if k and low[k] == low[k - 1] else re.sub(r"(.)\1+", r"\1", signs, flags=re.S))
    out = set()
    for kind, sequence, order in (("w", low, quality_svm.WORD_ORDER), ("s", shapes, quality_svm.SHAPE_ORDER)):
        for size in range(1, order + 1):
            out |= {(kind, size, tuple(sequence[i : i + size])) for i in range(len(sequence) - size + 1)}
    return out


def test_features_are_those_of_the_text():
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "AAA aaa AAA aaa!! aaa!!", "x9 x9 x9 9x", "Été ÉTÉ été", "b " * 3000, "w" * 100_000]
    texts += ["".join(rng.choice("ab AB\n1!é ") for _ in range(rng.randrange(80))) for _ in range(300)]
    flat, bounds = quality_svm.feature_sets(pa.array(texts), 1 << 40)
    names = {}
    for k, t in enumerate(texts):
        want, got = plain_features(t), set(flat[bounds[k] : bounds[k + 1]].tolist())
        assert len(want) == len(got), t
        for feature in want:
            one = quality_svm.feature_sets(pa.array([t]), 1 << 40)[0]
            names.setdefault(feature, set(one.tolist())).intersection_update(one.tolist())
    assert all(names.values())  # a feature has the same number wherever it stands


def test_hinge_fit_meets_its_conditions():
    rng = np.random.default_rng(5)
    rows, size, cost = 60, 30, 1.0
    flat = np.concatenate([np.sort(rng.choice(size, 6, replace=False)) for _ in range(rows)])
    values, bounds = rng.normal(size=len(flat)), np.arange(rows + 1) * 6
    labels = rng.integers(0, 2, rows)
    w = quality_svm.fit_hinge(flat, values, bounds, labels, size, cost, 3000)
    x = np.zeros((rows, size + 1))
    x[:, -1] = 1
    x[np.repeat(np.arange(rows), 6), flat] = values
    y = np.where(labels == 1, 1.0, -1.0)
    loss = lambda v: 0.5 * v @ v + cost * np.maximum(0, 1 - y * (x @ v)).sum()
    # At the least loss, w is a sum of rows whose multipliers are 0 beyond the margin and `cost` inside it.
    margin = y * (x @ w)
    fixed = (margin < 1 - 1e-2).astype(float) * cost
    rest = w - (fixed * y) @ x
    edge = np.flatnonzero(np.abs(margin - 1) <= 1e-2)
    dual = np.linalg.lstsq((x[edge] * y[edge, None]).T, rest, rcond=None)[0]
    assert np.abs((x[edge] * y[edge, None]).T @ dual - rest).max() < 2e-2 and dual.min() > -2e-2 and dual.max() < cost + 2e-2
    assert all(loss(w) <= loss(w + rng.normal(size=size + 1) * step) + 1e-3 for step in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_ratios_and_sums_are_over_all_rows(spark, monkeypatch):
    find_package(spark)
    monkeypatch.setattr(partials, "FAN_IN", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["aa", "Bb", "c!", "d9"]) for _ in range(rng.randrange(0, 9)))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in rows], "doc_id long, text string, id string, label int").repartition(11)
    labels = spark.createDataFrame([(i, i % 5 != 0) for i in range(0, 400, 2)], "doc_id long, q boolean").selectExpr("doc_id", "cast(q AS int) AS quality")
    model = quality_svm.learn(docs, labels, buckets=1 << 13, fit_rows=50)
    counts, seen = np.zeros((2, 1 << 13)), [0, 0]
    for i, t in rows:
        if i % 2 == 0 and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[int(i % 5 != 0)][quality_svm.feature_sets(pa.array([t]), 1 << 13)[0]] += 1
            seen[int(i % 5 != 0)] += 1
    assert np.allclose(model.ratios, quality_svm.log_ratios(counts)) and model.base == seen[1] / sum(seen)


def test_held_out_rows_and_labels_do_not_matter_to_learning(spark):
    find_package(spark)
    rows = [(i, "good words here and there" if i % 4 else "JUNK!! junk!! " * 3) for i in range(200)]
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    full = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows], "doc_id long, quality int")
    flipped = full.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality_svm.learn(docs, full), quality_svm.learn(docs, flipped)
    assert (a.weights == b.weights).all() and (a.ratios == b.ratios).all() and (a.slope, a.constant) == (b.slope, b.constant)
    got = {r.doc_id: r for r in quality_svm.score(docs, a).collect()}
    assert all(got[i].predicted == int(i % 4 > 0) and got[i].held_out == (i not in learned) for i, _ in rows)


def test_classifier_edge_cases(spark):
    find_package(spark)
    a, b, c, d, e = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:5]
    docs = spark.createDataFrame([(a, "a"), (a, "a"), (b, None), (None, "b"), (c, ""), (d, "x " * 50_000)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality_svm.learn(docs, labels([]))
    assert {r.score for r in quality_svm.score(docs, model).collect()} == {0.5}
    assert quality_svm.learn(docs, labels([(b, 1), (d, 1), (None, 0), (a, None), (e, 0)])).base == 1.0
    both = labels([(a, 0), (b, 1), (c, 1), (d, 1), (d, 0), (a, 7)])
    model = quality_svm.learn(docs, both)
    assert model.base == 0.5  # a twice, b and c; d has two different labels
    rows = quality_svm.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality_svm.score(docs.limit(0), model).count() == 0 and quality_svm.learn(docs.limit(0), both).base == 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op11_quality_svm(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert len(rows) == 1000 and area > 0.98 and sum(p == y for _, y, p in held) / len(held) > 0.95


# Centroids


def plain_clusters(rows, dims, units, count, rounds, seed):
    kept = [(i, [math.floor(units * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[place(v)].append(v)
        centroids = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(centroids)]
    out = [(i, place(v), far(v, centroids[place(v)])) for i, v in kept]
    inertia = Counter()
    for _, k, d in out:
        inertia[k] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digests[k]) for i, k, d in out), key=str)


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_clusters(spark, monkeypatch, leading):
    find_package(spark)
    monkeypatch.setattr(rotated_means, "ROWS", 7)
    rng = random.Random(leading)
    rows = [(i, [rng.choice([-2, 0, 1.5]) + rng.gauss(0, 0.4) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [1.0] * 6) for i in range(90)] + [(7, rows[7][1]), (None, [0.5] * 6), (None, None), (401, [1.0] * 5), (402, [None] + [1.0] * 5), (403, [math.nan] * 6), (404, [math.inf] + [0.0] * 5), (405, []), (406, [-0.0001] * 6)]
    rows += [(500 + i, [float(rng.randrange(-2, 3)) for _ in range(6)]) for i in range(60)]  # ties
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int").repartition(5)
    for count, rounds in ((8, 10), (3, 1), (20, 4)):
        got = rotated_means.cluster(df, dims=6, count=count, rounds=rounds, leading=leading).collect()
        assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=str) == plain_clusters(rows, 6, 1024, count, rounds, "3")


def test_few_and_no_vectors(spark):
    find_package(spark)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")
    got = rotated_means.cluster(df, dims=2, leading=2).collect()
    assert len(got) == 3 and {r.inertia for r in got} == {0}
    assert rotated_means.cluster(df, dims=3).count() == 0 and rotated_means.cluster(df.limit(0), dims=2).count() == 0
    with pytest.raises(Exception, match="larger than"):
        rotated_means.cluster(spark.createDataFrame([(1, [1e6, 0.0])], "vec_id long, embedding array<double>"), dims=2, leading=1).collect()


def test_bounds_never_pass_the_distance():
    rng = np.random.default_rng(2)
    for scale in (1, 1e3, 1e7):
        x = np.floor(rng.normal(size=(400, 64)) * scale).astype(np.int64)
        x[200:] = x[0] + rng.integers(-1, 2, (200, 64))
        centroids = x[rng.choice(400, 8)]
        turn = np.linalg.qr(rng.normal(size=(64, 64)))[0][:, :16]
        mean = x.mean(0)
        own, centres = (rotated_means.rotate(v.astype(np.float64), mean, turn) for v in (x, centroids))
        squares = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (rotated_means.least_roots(own, centres) <= np.sqrt(squares.astype(np.float64))).all()
        number, distance, looked = rotated_means.nearest(x, own, centroids, centres)
        assert (distance == squares.min(1)).all() and (number == squares.argmin(1)).all() and len(x) <= looked <= squares.size
    groups = rng.normal(size=(8, 64)) * 500
    x = np.floor(groups[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 64)) * 100).astype(np.int64)
    mean = x.mean(0)
    turn = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :16]
    centroids = np.floor(groups).astype(np.int64)
    own, centres = (rotated_means.rotate(v.astype(np.float64), mean, turn) for v in (x, centroids))
    assert rotated_means.nearest(x, own, centroids, centres)[2] < 1.05 * len(x)  # hardly any but the nearest is looked at


# Collocations


def plain_collocations(rows, longest, least, covered, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: v for p, v in f.items() if len(p) >= 2 and v >= least}
        rows_of = []
        for p, a in found.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                rows_of.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(4)
    pool = ["a", "B", "c", "dé", "E!", "f\tg", "h", "\x00", "ü", "'s"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", "  ", " \t"]).join(rng.choices(pool, k=rng.randrange(0, 25))) + rng.choice(["", ".", "\n", " b a\x0bc"])) for _ in range(500)]
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " . "), ("en", "x y z " * 3000), ("en", "the " * 5000)] + [("de", "the same of")] * 40


@pytest.mark.parametrize("options", [(3, 10, 50, 2000, 1_000_000), (3, 2, 80, 7, 40), (2, 3, 50, 2000, 100), (4, 4, 50, 25, 60)])
def test_collocations(spark, monkeypatch, chatter, options):
    find_package(spark)
    longest, least, covered, top, range_paths = options
    for name, value in (("SHARD_BYTES", 2000), ("MARKS", 6), ("GATHERED", 150), ("RANGES_AT_ONCE", 3), ("RANKED", 20), ("FAN_IN", 2)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(k, lang, text, "x", 1) for k, (lang, text) in enumerate(chatter)], "doc_id long, lang string, text string, phrase string, f int").repartition(6)
    got = collocations.mine(docs, longest=longest, least=least, covered=covered, top=top, range_paths=range_paths).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(chatter, longest, least, covered, top)


def test_no_collocations(spark):
    find_package(spark)
    docs = spark.createDataFrame([(None, None), ("en", ""), ("en", "just once")], "lang string, text string")
    assert collocations.mine(docs).count() == 0 and collocations.mine(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 2 * 10**12), ("en", "a b", 2, 10**12)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    assert [tuple(r) for r in collocations.scored(counts, totals, 50, 3).collect()] == [("en", "a b", 10**12, 3 * 10**12, 2 * 10**12, 10**13, 166666)]


def test_automata_share_states_and_keep_paths():
    texts = pa.array([f"w{i % 50} x y" for i in range(400)] + ["p q r. q r"] * 9 + ["big " * 70_000])
    paths = phrase_automata.text_paths(texts, ["en"] * len(texts), 3)["en"]
    again = phrase_automata.unpack(phrase_automata.pack(paths))
    assert again.words.to_pylist() == paths.words.to_pylist() and (again.weights == paths.weights).all()
    assert all((a == b).all() for a, b in zip(again.grams, paths.grams, strict=True))
    number, kept = phrase_automata.shared_states(np.array([1, 2, 1, 2, 1, 3, 2]), np.array([5, 5, 5, 5, 5, 5, 5]), np.array([0, 2, 4, 6]))
    assert len(kept) == 3 and number[0] == number[1] != number[2]


def test_a_common_beginning_is_spread_over_ranges(spark):
    find_package(spark)
    docs = spark.createDataFrame([("en", f"of the w{i}") for i in range(4000)], "lang string, text string").repartition(4)
    stored = collocations.shards(docs, 3, "lang", "text").cache()
    bounds = collocations.range_bounds(stored, 500)
    assert sum(mark[:2] == [b"of", b"the"] for _, mark in bounds) > 5
    got = {r.phrase: r.f for r in collocations.phrase_counts(stored, bounds, 10).collect()}
    assert got == {"of": 4000, "the": 4000, "of the": 4000}
    stored.unpersist()
