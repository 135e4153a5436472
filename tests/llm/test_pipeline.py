"""The pipeline, stage by stage, against brute force on the smallest table."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from alertloom.llm import mixing, quality
from alertloom.llm.common import table

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, outputs):
    columns = table(spark, SF, "documents").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert all(o.columns == columns for o in outputs[:-1])


def test_quality_stage(spark, outputs):
    docs = table(spark, SF, "documents")
    want = docs.join(quality.assess(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    assert outputs[0].exceptAll(want).isEmpty() and want.exceptAll(outputs[0]).isEmpty() and 0 < want.count() < docs.count()
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(quality.assess(docs).where("NOT base_failed"), "doc_id")
    assert good.where("NOT kept").count() == 0


def test_dedup_stages(outputs):
    before = outputs[0].collect()
    last = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        last[lower(r.text)] = r
    assert sorted(outputs[1].collect()) == sorted(last.values())
    rows = sorted(last.values(), key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if group[i] != group[j] and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert sorted(outputs[2].collect()) == [r for i, r in enumerate(rows) if group[i] == i]


def test_mix_and_pack_stages(outputs):
    want = mixing.mix(outputs[2], mixing.source_rates(outputs[2])).select(outputs[2].columns)
    assert Counter(want.collect()) == Counter(outputs[3].collect()) and want.count() > 0
    ends = {}
    for r in outputs[4].orderBy("sequence_id", "offset").collect():
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and outputs[4].where("piece = 0").count() == outputs[3].count()
