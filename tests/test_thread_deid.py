"""Threads rewritten by their own names, against the rewriting of one thread at a time by a fixed list."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import deid
from alertloom.operators import thread_deid as td

SALT = "a-private-salt"
MESSAGE = "conv_id long, channel string, turn long, ts timestamp, role string, author string, text string"
PEOPLE = ["Ann", "ann marie", "J. R. Ewing", "@bob", "o'neil", "Ünal", "a.b*c", "\\E+x", "123", "well-known"]
HOSTS = ["db-1", "db-1 standby", "ann", "core.rack"]


def threads():
    rng = random.Random(6)
    names = {c: (rng.sample(PEOPLE, rng.randrange(0, 5)), rng.sample(HOSTS, rng.randrange(0, 3))) for c in range(12)}
    rows = []
    for c in names:
        for turn in range(6):
            words = [rng.choice([*PEOPLE, *HOSTS, "ANN", "ann-marie", "ÜNAL", "xann", "mail a@b.io", "10.0.0.1", "token: ann", "J.", "fine"]) for _ in range(rng.randrange(1, 12))]
            rows.append((c, "ops", turn, None, "user", "Ann", rng.choice([" ", ", ", "-", "\n"]).join(words)))
    return rows, names


def test_each_thread_by_its_own_names(spark):
    rows, names = threads()
    messages = spark.createDataFrame(rows, MESSAGE).repartition(4)
    listed = [(c, td.USER, n) for c, (people, _) in names.items() for n in people] + [(c, td.HOST, n) for c, (_, hosts) in names.items() for n in hosts]
    known = spark.createDataFrame([*listed, *listed, (0, td.USER, None), (None, td.USER, "nobody")], "conv_id long, category string, name string")
    got = {(r.conv_id, r.turn): (r.text, sorted(map(tuple, r.deid_hits), key=str), r.residue) for r in td.deidentify_messages(messages, known, SALT, strict=False).collect()}
    assert len(got) == len(rows)
    for c, (people, hosts) in names.items():
        alone = deid.deidentify(messages.where(F.col("conv_id") == c), "text", SALT, people, hosts, strict=False)
        for r in alone.collect():
            assert got[c, r.turn] == (r.text, sorted(map(tuple, r.deid_hits), key=str), r.residue), (names[c], r.turn)


def test_report_caps_and_errors(spark):
    rows = [(1, "ops", t, None, "user", f"Ann {t % 2}", f"call Ann {t % 2} at 10.0.0.{t} password=x{t} " + "why " * 10) for t in range(5)] + [(2, "ops", 0, None, "user", "Bob", "Ann 0 is no name here")]
    messages = spark.createDataFrame(rows, MESSAGE)
    known = spark.createDataFrame([(1, td.USER, "Ann 0"), (1, td.USER, "ANN 1"), (2, td.USER, "Bob")], "conv_id long, category string, name string")
    kept, report, counters = td.deidentify_threads(messages, known, SALT, max_messages=2, max_chars=30)
    out = kept.orderBy("conv_id", "turn").collect()
    assert len(out) == 3 and len({r.conv_id for r in out}) == 2 and all(r.conv_id.startswith("thread-") and r.channel.startswith("channel-") and r.author.startswith("user-") for r in out)
    one = [r for r in out if r.turn >= 3]
    assert all(len(r.text) == 30 and r.was_cut and "Ann" not in r.text for r in one) and [r.text for r in out if r.turn == 0] == ["Ann 0 is no name here"]
    found = {(r.conv_id, r.category): (r.occurrences, r.distinct_pseudonyms) for r in report.collect()}
    t1 = one[0].conv_id
    assert {k[1]: v for k, v in found.items() if k[0] == t1} == {"author": (5, 2), "username": (5, 2), "ipv4": (5, 5), "secret:key_value": (5, 0)}
    c = {r.conv_id: r for r in counters.collect()}[t1]
    assert (c.original_message_count, c.messages_kept, c.messages_dropped, c.messages_cut) == (5, 2, 3, 2)
    with pytest.raises(Exception, match="at least 3"):
        td.deidentify_messages(messages, known.withColumn("name", F.lit("Al")), SALT).count()
    blank = spark.createDataFrame([(1, "ops", 0, None, "user", "Ann", "  ")], MESSAGE)
    with pytest.raises(Exception, match="text must not be empty"):
        td.deidentify_threads(blank, known, SALT)
