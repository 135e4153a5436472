"""Dataset lint: every rule yields violation rows (rule, key, detail), never silent drops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom import fixed_values as fv
from alertloom.operators.barrier import computed_once
from alertloom.operators.rubric import label_nested

LEAK_KEYS = ("pair_id", "template_family", "wrapper_family", "slang_term")
REQUIRED = ("seed_source", "template_id", "template_family", "pair_id", "split", "provenance")


def union_violations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def split_list(flags: Sequence[str] = (*fv.SPLITS, "other")) -> Column:
    return F.concat_ws(",", *[F.when(F.col(f"in_{s}"), s) for s in flags])


def _split_flags(split: Column) -> list[Column]:
    known = [F.bool_or(split == s).alias(f"in_{s}") for s in fv.SPLITS]
    return [*known, F.bool_or(~split.isin(*fv.SPLITS)).alias("in_other")]


def leaks(cases: DataFrame, keys: Sequence[str] = LEAK_KEYS) -> DataFrame:
    """Key values whose rows lie in more than one split. NULL and "none" do not count.

    One pass over the rows; a key value carries only a flag per split, so a hot value costs nothing.
    """
    present = [F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys]
    opened = cases.select("split", F.explode(F.array(*present)).alias("x")).where(F.col("x.v").isNotNull() & (F.col("x.v") != "none"))
    g = opened.groupBy(F.col("x.k").alias("k"), F.col("x.v").alias("v")).agg(*_split_flags(F.col("split")))
    n = sum((F.col(f"in_{s}").cast("int") for s in (*fv.SPLITS, "other")), F.lit(0))
    return g.where(n > 1).select(F.concat(F.lit("leak_"), F.col("k")).alias("rule"), F.col("v").alias("key"), split_list().alias("detail"))


def group_leaks(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """Components that span splits."""
    of_pair = cases.groupBy(F.col("pair_id").cast("string").alias("pair_id")).agg(*_split_flags(F.col("split")))
    flags = [F.bool_or(f"in_{s}").alias(f"in_{s}") for s in (*fv.SPLITS, "other")]
    g = of_pair.join(groups, "pair_id").groupBy("group_id").agg(*flags)
    n = sum((F.col(f"in_{s}").cast("int") for s in (*fv.SPLITS, "other")), F.lit(0))
    return g.where(n > 1).select(F.lit("leak_group").alias("rule"), F.col("group_id").alias("key"), split_list().alias("detail"))


def pinned_families(cases: DataFrame, pins: Mapping[str, str]) -> DataFrame:
    """Wrapper families pinned to one split that appear in another."""
    home = F.try_element_at(F.create_map(*[x for k, v in pins.items() for x in (F.lit(k), F.lit(v))]), F.col("wrapper_family"))
    bad = cases.withColumn("home", home).where(F.col("home").isNotNull() & (F.col("home") != F.col("split")))
    return bad.groupBy("wrapper_family", "home").agg(*_split_flags(F.col("split"))).select(
        F.lit("pinned_family").alias("rule"), F.col("wrapper_family").alias("key"),
        F.concat(F.lit("pinned to "), F.col("home"), F.lit(", also in "), split_list()).alias("detail"),
    )


def coverage(cases: DataFrame, event_types: Sequence[str] = fv.EVENT_TYPES) -> DataFrame:
    """Per split, the event types, page values and P levels its gold rows lack."""
    wanted = {
        "event_type": [(t, F.col("gold_event_type") == t) for t in event_types],
        "page_now": [("true", F.col("gold_page_now")), ("false", ~F.col("gold_page_now"))],
        "priority": [(p, F.col("gold_priority") == p) for p in fv.PRIORITIES],
    }
    aggs = [F.coalesce(F.bool_or(cond), F.lit(False)).alias(f"{task}|{v}") for task, vs in wanted.items() for v, cond in vs]
    have = cases.where(F.col("gold_event_type").isNotNull()).groupBy("split").agg(*aggs)
    dims = cases.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in fv.SPLITS])).alias("split"))
    full = dims.join(have, "split", "left").na.fill(False)
    rows = [
        F.struct(
            F.lit(f"coverage_{task}").alias("rule"),
            F.concat_ws(",", *[F.when(~F.col(f"{task}|{v}"), v) for v, _ in vs]).alias("detail"),
        )
        for task, vs in wanted.items()
    ]
    return full.select(F.col("split").alias("key"), F.explode(F.array(*rows)).alias("r")).where(F.col("r.detail") != "").select("r.rule", "key", "r.detail")


# ------------------------------------------------------------------ text rules
def leak_names(text: Column) -> Column:
    """Indexes (1-based) of the forbidden answer-stating patterns found in a text."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(i + 1)) for i, p in enumerate(fv.LEAK_PATTERNS)]))


def foreign_ips(text: Column) -> Column:
    """Valid IPv4 tokens outside the documentation blocks, without leading zeros."""
    found = F.regexp_extract_all(text, F.lit(fv.LINT_IPV4), F.lit(0))
    plain = F.transform(found, lambda ip: F.array_join(F.transform(F.split(ip, r"\."), lambda o: o.cast("int").cast("string")), "."))

    def is_foreign(ip: Column) -> Column:
        octets = F.split(ip, r"\.")
        valid = F.forall(octets, lambda o: o.cast("int") <= 255)
        documented = F.lit(False)
        for block in fv.DOC_IPV4_BLOCKS:
            documented = documented | ip.startswith(block + ".")
        return valid & ~documented

    return F.filter(plain, is_foreign)


def row_rules(cases: DataFrame, dataset_kind: str, lexicon: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Every rule decided by one row, in one pass.

    The rows are first tested, by compiled code, for any finding at all; the findings are listed for those that have one.

    `cases` holds the case columns plus dataset_kind, seed_source, template_id, wrapper_family,
    slang_term, provenance, raw, window (array), label_status, label_version, has_label, has_expected,
    label_page_now. `lexicon` is the versioned list of (term, split) held out per split.
    """
    c = F.col
    text = F.concat_ws("\n", c("raw"), c("window"))
    bprime = c("cohort") == "B_prime"
    claim = text.rlike("(?i)" + fv.PAYLOAD_CLAIM)

    any_of = []

    def rule(name: str, cond: Column, detail: Column | str) -> Column:
        any_of.append(cond)
        d = detail if isinstance(detail, Column) else F.lit(detail)
        return F.array(F.when(cond, F.struct(F.lit(name).alias("rule"), d.alias("detail"))))

    def each(name: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(name).alias("rule"), x.cast("string").alias("detail")))

    terms = F.array(*[F.struct(F.lit(t.lower()).alias("t"), F.lit(s).alias("s")) for t, s in lexicon]) if lexicon else None
    found = [
        rule("dataset_kind", ~F.coalesce(c("dataset_kind") == dataset_kind, F.lit(False)), F.coalesce(c("dataset_kind"), F.lit("null"))),
        *[rule("missing_" + f, F.coalesce(c(f).cast("string"), F.lit("")) == "", f) for f in REQUIRED],
        rule("unknown_split", ~F.coalesce(c("split").isin(*fv.SPLITS), F.lit(False)), F.coalesce(c("split"), F.lit("null"))),
        each("foreign_ip", foreign_ips(text)),
        rule("unresolved_placeholder", text.contains(fv.PLACEHOLDER), fv.PLACEHOLDER),
        F.when(~c("cohort").isin(*fv.LEAK_EXEMPT_COHORTS), each("answer_in_text", leak_names(text))).otherwise(F.array().cast("array<struct<rule:string,detail:string>>")),
        rule("claim_outside_b_prime", ~bprime & claim & c("slang_term").isNull(), c("cohort")),
        rule("b_prime_without_claim", bprime & ~claim, c("cohort")),
        rule("d_must_be_unlabeled", (c("cohort") == "D") & (c("has_label") | c("has_expected") | (c("label_status") != "needs_adjudication")), c("label_status")),
        rule("must_be_rubric_derived", (c("cohort") != "D") & ((c("label_status") != "rubric_derived") | ~c("has_label")), c("label_status")),
        rule("label_version", (c("cohort") != "D") & c("has_label") & (c("label_version") != fv.RUBRIC_VERSION), c("label_version")),
        rule("b_prime_lost_page", bprime & c("has_label") & ~c("label_page_now"), c("cohort")),
    ]
    any_of.append(text.contains(".") & text.rlike(fv.LINT_IPV4))
    any_of.append(~c("cohort").isin(*fv.LEAK_EXEMPT_COHORTS) & reduce(or_, [text.rlike("(?i)" + p) for p in fv.LEAK_PATTERNS]))
    if terms is not None:
        any_of += [(F.lit(s) != c("split")) & F.lower(c("raw")).contains(t.lower()) for t, s in lexicon]
        held = F.filter(terms, lambda t: (t["s"] != c("split")) & F.lower(c("raw")).contains(t["t"]))
        found.append(each("lexicon_term", F.transform(held, lambda t: t["t"])))
    opened = cases.where(reduce(or_, any_of)).select(c("case_id").cast("string").alias("key"), F.explode(F.array_compact(F.flatten(F.array(*found)))).alias("v"))
    return opened.select("v.rule", "key", "v.detail")


def all_strings(df: DataFrame, *columns: str) -> Column:
    """An array of every string anywhere inside the columns: in structs, arrays and maps of any depth, by the schema."""

    def inside(value: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(value)
        if isinstance(kind, T.StructType):
            found = [x for f in kind.fields if (x := inside(value.getField(f.name), f.dataType)) is not None]
            return F.concat(*[F.coalesce(x, none) for x in found]) if found else None
        if isinstance(kind, T.MapType):
            return F.concat(*[F.coalesce(x, none) for x in (inside(F.map_keys(value), T.ArrayType(kind.keyType)), inside(F.map_values(value), T.ArrayType(kind.valueType))) if x is not None])
        if isinstance(kind, T.ArrayType):
            probe = inside(F.lit(None).cast(kind.elementType), kind.elementType)
            return None if probe is None else F.flatten(F.transform(value, lambda e: F.coalesce(inside(e, kind.elementType), none)))
        return None

    none = F.array().cast("array<string>")
    found = [x for c in columns if (x := inside(F.col(c), df.schema[c].dataType)) is not None]
    return F.array_compact(F.concat(none, *[F.coalesce(x, none) for x in found]))


def string_rules(cases: DataFrame, *columns: str) -> DataFrame:
    """Foreign addresses, placeholders and unfilled slots in any string of the columns, by default event and context."""
    strings = all_strings(cases, *(columns or ("event", "context")))
    slot = r"\{(?:" + "|".join(fv.AUTHORED_SLOTS) + r")\}"

    def named(rule: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("detail")))

    each = F.flatten(F.transform("_strings", lambda t: F.concat(
        named("foreign_ip", foreign_ips(t)),
        named("unresolved_placeholder", F.when(t.contains(fv.PLACEHOLDER), F.array(F.lit(fv.PLACEHOLDER))).otherwise(F.array().cast("array<string>"))),
        named("unfilled_slot", F.regexp_extract_all(t, F.lit(slot), F.lit(0))),
    )))
    opened = cases.select(F.col("case_id").cast("string").alias("key"), strings.alias("_strings")).select("key", F.explode(each).alias("v"))
    return opened.select("v.rule", "key", "v.detail")


def rederived(cases: DataFrame) -> DataFrame:
    """Labels of stored cases that the rubric, run again on their evidence and context, rejects or does not give.

    `cases` is the stored layout with a `label` of the rubric's own fields. Every field of the label counts.
    """
    stored = cases.where(F.col("label").isNotNull()).withColumnRenamed("label", "_stored")
    again = computed_once(label_nested(stored).select("case_id", "_stored", "label", "error"), "label", "error")
    fields = [f for f in cases.schema["label"].dataType.names if f in again.schema["label"].dataType.names]
    differs = [F.when(~F.col(f"_stored.{f}").eqNullSafe(F.col(f"label.{f}")), f) for f in fields]
    same = F.struct(*[F.col(f"_stored.{f}") for f in fields]).eqNullSafe(F.struct(*[F.col(f"label.{f}") for f in fields]))
    # array_compact runs outside compiled code: the many comparisons of the detail would make the code of the test too long to be compiled
    detail = F.when(F.col("error").isNotNull(), F.concat(F.lit("rubric rejects stored case: "), F.col("error"))).otherwise(F.array_join(F.array_compact(F.array(*differs)), ","))
    bad = again.where(F.col("error").isNotNull() | ~same)
    return bad.select(F.lit("label_recheck").alias("rule"), F.col("case_id").cast("string").alias("key"), detail.alias("detail"))


def label_recheck(stored: DataFrame, derived: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Stored labels that differ from the re-derived ones, or that the rubric rejects."""
    d = derived.select(F.col("case_id"), "error", *[F.col(f).alias(f"_d_{f}") for f in fields])
    j = stored.join(d, "case_id", "left")
    differs = [F.when(~F.col(f).eqNullSafe(F.col(f"_d_{f}")), f) for f in fields]
    detail = F.when(F.col("error").isNotNull(), F.concat(F.lit("rubric rejects stored case: "), F.col("error"))).otherwise(F.concat_ws(",", *differs))
    return j.select(F.lit("label_recheck").alias("rule"), F.col("case_id").cast("string").alias("key"), detail.alias("detail")).where("detail <> ''")


# ------------------------------------------------------------------ contracts
def case_contract(cases: DataFrame, split_from_path: str = "file_split") -> DataFrame:
    """Split equals its file, the three questions in order, known cohort, unique id, D ungraded."""
    c = F.col
    tasks = F.array(*[F.lit(t) for t in fv.TASKS])

    def rule(name: str, cond: Column, detail: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.coalesce(detail.cast("string"), F.lit("null")).alias("detail")))

    checks = F.array_compact(
        F.array(
            rule("split_differs_from_file", c("split") != c(split_from_path), c("split")),
            rule("questions", c("questions") != tasks, F.array_join("questions", ",")),
            rule("unknown_cohort", ~c("cohort").isin(*fv.COHORTS), c("cohort")),
            rule("d_must_be_ungraded", (c("cohort") == "D") & c("has_label"), c("cohort")),
        )
    )
    rows = cases.select(c("case_id").cast("string").alias("key"), F.explode(checks).alias("v")).select("v.rule", "key", "v.detail")
    dup = (
        cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("duplicate_case_id").alias("rule"), c("case_id").cast("string").alias("key"), c("n").cast("string").alias("detail"))
    )
    return rows.unionByName(dup)


def expected_matches_label(cases: DataFrame) -> DataFrame:
    """Rows whose expected answers differ from the stored label; both NULL is fine, one NULL is not."""
    same = (
        F.col("gold_event_type").eqNullSafe(F.col("label_event_type"))
        & F.col("gold_page_now").eqNullSafe(F.col("label_page_now"))
        & F.col("gold_priority").eqNullSafe(F.col("label_priority"))
    )
    return cases.where(~same).select(F.lit("expected_differs_from_label").alias("rule"), F.col("case_id").cast("string").alias("key"), F.col("cohort").alias("detail"))


def catalog_contract(templates: DataFrame, pools: DataFrame, min_pool: int = 3, min_pairing: int = 4) -> DataFrame:
    """Pool members unknown to the catalog, templates in two pools, pools too small, repeated template ids.

    A pool with `pairs` set, from which pairs are made too, needs `min_pairing` templates.
    """
    pairs = F.coalesce(F.max("pairs"), F.lit(False)) if "pairs" in pools.columns else F.lit(False)
    unknown = pools.join(templates.select("template_id"), "template_id", "left_anti").select(
        F.lit("unknown_template").alias("rule"), F.col("template_id").cast("string").alias("key"), F.col("pool").cast("string").alias("detail")
    )
    shared = (
        pools.groupBy("template_id").agg(F.min("pool").alias("a"), F.max("pool").alias("b")).where("a <> b")
        .select(F.lit("template_in_two_pools").alias("rule"), F.col("template_id").cast("string").alias("key"), F.concat_ws(",", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail"))
    )
    small = (
        pools.groupBy("pool").agg(F.count_distinct("template_id").alias("n"), pairs.alias("pairs"))
        .where(F.col("n") < F.when(F.col("pairs"), min_pairing).otherwise(min_pool))
        .select(F.lit("pool_too_small").alias("rule"), F.col("pool").cast("string").alias("key"), F.col("n").cast("string").alias("detail"))
    )
    repeated = (
        templates.groupBy("template_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("duplicate_template_id").alias("rule"), F.col("template_id").cast("string").alias("key"), F.col("n").cast("string").alias("detail"))
    )
    return union_violations([unknown, shared, small, repeated])


def plan_contract(terms: DataFrame, families: DataFrame, held_out: Sequence[str] = ("val", "test")) -> DataFrame:
    """Topics without a term for a split, terms listed more than once, splits for which no wrapper family is held out.

    `terms` is (topic, split, term), `families` (name, split).
    """
    lists = F.transform(F.array(*[F.lit(s) for s in fv.SPLITS]), lambda s: F.when(~F.array_contains(F.collect_set("split"), s), s))
    bare = terms.where("term IS NOT NULL").groupBy("topic").agg(F.array_compact(lists).alias("none")).where(F.size("none") > 0)
    missing = bare.select(F.lit("topic_without_term").alias("rule"), F.col("topic").alias("key"), F.array_join("none", ",").alias("detail"))
    repeated = (
        terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("term_not_unique").alias("rule"), F.col("term").alias("key"), F.col("n").cast("string").alias("detail"))
    )
    found = families.agg(*[F.count_if(F.col("split") == s).alias(s) for s in held_out])
    gaps = F.array_compact(F.array(*[F.when(F.col(s) == 0, s) for s in held_out]))
    unheld = found.select(F.explode(gaps).alias("key")).select(F.lit("no_family_held_out").alias("rule"), "key", F.lit("wrapper family").alias("detail"))
    return union_violations([missing, repeated, unheld])


def tallies(cases: DataFrame) -> DataFrame:
    """Counts by cohort, split, split/cohort, gold type, priority and page: one pass, then sums of the small table."""
    fine = cases.groupBy("cohort", "split", "gold_event_type", "gold_priority", "gold_page_now").agg(F.count(F.lit(1)).alias("c"))

    def t(name: str, key: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(F.lit(name).alias("tally"), key.cast("string").alias("key")))

    s, k = F.col("split"), F.col("cohort")
    items = F.array_compact(
        F.array(
            t("total", F.lit("all")), t("by_cohort", k), t("by_split", s), t("by_split_and_cohort", F.concat(s, F.lit("/"), k)),
            t("gold_by_event_type", F.col("gold_event_type")), t("gold_by_priority", F.col("gold_priority")),
            t("gold_by_page_now", F.col("gold_page_now")), t("gold_by_split_priority", F.concat(s, F.lit("/"), F.col("gold_priority"))),
        )
    )
    return fine.select("c", F.explode(items).alias("i")).groupBy("i.tally", "i.key").agg(F.sum("c").alias("n"))
