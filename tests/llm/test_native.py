"""Operators in built-in functions only, against brute force in plain Python."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.llm import block_names, licenses, mixing, quality

SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, source string, id string, block string, row string"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["the", "of", "la", "Wort", "é", "x#y", "a|b", "und", "...", "•"]
    out = [None, "", " \t\n\r\x0b\x0c", "\n\n", "the", "one\xa0word", "a b c d", "A B c d e", "a b c d e a b c d e", "x " * 500, "İstanbul ß Σ" * 3, "y" * 5000, "y" * 5000]
    for _ in range(150):
        line = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))
        out.append(rng.choice(["\n", "\n\n", " \n"]).join(rng.choices([line() for _ in range(4)], k=rng.randrange(1, 9))))
    return out + out[20:40] + [t.upper() for t in out[40:60]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 3}", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def brute_repeats(w):
    runs = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for k in range(5)})


def test_quality_counts(spark, docs, texts):
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, r = words(t), got[i]
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == brute_repeats(w), t
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_keeps_rows_as_they_are(spark, docs):
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and kept.exceptAll(docs).isEmpty() and kept.count() == quality.assess(docs).where("kept").count()
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.assess(docs.limit(0)).count() == 0


def test_quality_needs_no_python(spark, docs):
    plan = quality.assess(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("options", [{}, {"block_chars": 3, "heavy_rows": 2, "buckets": 4}])
def test_exact_groups(spark, docs, texts, options):
    got = {r.doc_id: r for r in block_names.exact_groups(docs, **options).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(texts)
    for t, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(members), len(members), i == max(members)), repr(t)[:50]
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_of_repeated_rows_and_nulls(spark):
    rows = [(1, "A"), (1, "a"), (1, "b"), (None, "a"), (None, None), (2, ""), (2, ""), (3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = block_names.exact_groups(df).collect()
    assert len(got) == len(rows)
    kept = block_names.drop_copies(df.withColumn("copy_hash", F.lit("mine"))).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept) == [(1, "a"), (1, "b"), (2, ""), (3, "c")] and all(r.copy_hash == "mine" for r in kept)
    assert block_names.exact_groups(df.limit(0)).count() == 0 and block_names.drop_copies(df.limit(0)).count() == 0


def poisson(rate, u):
    k, total, term = 0, 0.0, math.exp(-rate)
    while True:
        total += term
        if total > u:
            return k
        k += 1
        term *= rate / k


def test_mix_inverts_poisson(spark, docs, texts):
    rates = mixing.source_rates(docs, weights={"s0": 3.0, "s1": 1.0}, epochs=2.0)
    rate = {r.source: r.rate for r in rates.collect()}
    assert rate["s2"] == 0 and rate[None] == 0 and rate["s0"] > 0
    got = Counter(r.doc_id for r in mixing.mix(docs, rates).collect())
    for i in range(len(texts)):
        m = rate[None if i % 7 == 0 else f"s{i % 3}"]
        parts = max(1, math.ceil(m / 8))
        us = [int(hashlib.md5(f"mix-1:{i}:{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(1, parts + 1)]
        assert got[i] == (sum(poisson(m / parts, u) for u in us) if m else 0)


def test_mix_meets_weights_and_shuffles(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.lit(50)).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.lit(9).alias("copy"))
    mixed = mixing.mix(df, mixing.source_rates(df, weights={"hot": 1, "s1": 1, "s2": 20}))
    share = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(share) == {"hot", "s1", "s2"} and abs(share["s2"] / sum(share.values()) - 20 / 22) < 0.02
    order = [r.doc_id for r in mixed.limit(200).collect()]
    assert order != sorted(order) and mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    assert mixing.mix(df.limit(0), mixing.source_rates(df.limit(0))).count() == 0


def test_license_scan(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    body = licenses.KNOWN[0][1]
    rows = [
        (1, body), (2, "Copyright (c) 2020 Someone\n\n" + body.upper().replace("SUBLICENSE", "SUB-LICENCE")), (3, "© 2021 X. All rights reserved.\n" + body.replace(",", " ;")),
        (4, body + "\nand one line more"), (5, "text\nReleased under the MIT licence!\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0"), (6, None), (7, ""), (8, "Copyright 2020"), (9, mit), (9, mit),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = [(r.doc_id, r.license, r.n_notices, r.notices) for r in licenses.scan(df, licenses.known_licenses(spark)).orderBy("doc_id").collect()]
    assert [g[:2] for g in got[:4]] == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None)]
    assert got[4] == (5, None, 3, "CC-BY-NC-4.0,MIT") and [g[1:] for g in got[5:8]] == [(None, 0, "")] * 3
    assert len(got) == len(rows) and got[8] == got[9]
    assert licenses.scan(df.limit(0), licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(df, licenses.known_licenses(spark).limit(0)).where("license IS NOT NULL OR n_notices > 0").count() == 0


def test_license_scan_of_wrapped_files(spark):
    texts = {}
    for name, text in licenses.KNOWN:
        texts.setdefault(name, text)
    head, rows, want = "Copyright (c) 2020, Some One <s@example.org>\nCopyright Acme Corp\nAll rights reserved.\n\n", [], []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        for width in range(40, 100):
            rows.append((len(rows), head + "\n\n".join(textwrap.fill(part, width) for part in texts[name].split("\n") if part)))
            want.append(name)
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n"
    rows.append((len(rows), isc + texts["ISC"].split("\n")[1]))
    want.append("ISC")
    for name, text in licenses._long_texts():
        rows.append((len(rows), re.sub(r"[ \t]+", " ", text).replace("\n", "\r\n")))
        want.append(name)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"} < set(want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df, licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_license_sql_says_the_same_of_wrapped_and_odd_texts(spark):
    import duckdb

    from alertloom.llm import queries

    rng = random.Random(3)
    texts = []
    for _, t in licenses.KNOWN:
        texts += [t] + ["\n".join(textwrap.fill(line, w) for line in t[:4000].split("\n")) for w in (40, 72) if len(t) > 300]
    heads = ["Copyright (c) 2020 Ann", "Copyright 1999, 2001 Bob", "© Foo Ltd", "(c) 2011 x", "(c) copyright notice", "(c) Copyright Ann", "Copyright Ann Bee", "copyright ann", "Copyright holder x", "COPYRIGHT NOTICE"]
    heads += ["  * Copyright <year>", "Copyright by me", "all rights reserved.", "keep the", "Copyright and more", "(C) [yyyy]", "licence,", "Copyright licence"]
    texts += ["\n".join(rng.choice(heads) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    rows = list(enumerate(texts))
    scanned = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, text_digest, license, n_notices, notices FROM ({queries.ORACLES['op3_license_scan']})").fetchall()
    got = [(r.doc_id, r.text_digest, r.license, r.n_notices, r.notices) for r in scanned.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] is not None for r in got) > 40
