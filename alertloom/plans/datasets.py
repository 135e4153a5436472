"""Registered dataset queries: splits, leakage, components, lint, tallies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertloom import fixed_values as fv
from alertloom import fixtures as fx
from alertloom.operators import components as cc
from alertloom.operators import lint as li
from alertloom.operators import rubric as rb
from alertloom.operators import splits as sp
from alertloom.operators import textmatch as tm
from alertloom.operators.barrier import computed_once
from alertloom.plans.labeling import _LABEL
from alertloom.session import cut_lineage

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_TYPES = ("signup", "error", "click", "view", "purchase")
_CASES = fx.sql_with("cases")
_LINT = fx.sql_with("cases", "lint")
_SPLITS = "concat_ws(',', CASE WHEN bool_or(split = 'train') THEN 'train' END, CASE WHEN bool_or(split = 'val') THEN 'val' END, CASE WHEN bool_or(split = 'test') THEN 'test' END)"


@query(
    "w4_stratified_split",
    """WITH r AS (SELECT event_id AS case_id, row_number() OVER (ORDER BY event_type, md5('42:' || event_id), event_id) - 1 AS idx, count(*) OVER () AS n FROM events),
k AS (SELECT max(n) AS n, floor(max(n) * 0.15::DOUBLE + 0.5::DOUBLE)::BIGINT AS k FROM r),
p AS (SELECT floor((j + 0.25::DOUBLE) * n / k)::BIGINT AS idx, 'test' AS s FROM k, range(0, k) t(j)
  UNION ALL SELECT floor((j + 0.75::DOUBLE) * n / k)::BIGINT, 'val' FROM k, range(0, k) t(j))
SELECT r.case_id, r.idx AS index, coalesce(p.s, 'train') AS new_split FROM r LEFT JOIN p USING (idx)""",
)
def w4_stratified_split(spark, sf_dir):
    rows = fx.events(spark, sf_dir).select(F.col("event_id").alias("case_id"), "event_type")
    return sp.stratified_split(rows, ["event_type"], "case_id").select("case_id", "index", "new_split")


_FAMILY = """fam AS (SELECT *, CASE WHEN pos < held THEN 'test' WHEN pos < 2 * held THEN 'val' ELSE 'train' END AS split FROM (
  SELECT pool, family, row_number() OVER (PARTITION BY pool ORDER BY md5('42:' || family), family) - 1 AS pos,
    greatest(1, floor(count(*) OVER (PARTITION BY pool) * 0.15::DOUBLE + 0.5::DOUBLE)) AS held
  FROM (SELECT DISTINCT event_type AS pool, event_id // 8 AS family FROM events)))"""


def _families(spark, sf_dir):
    return fx.events(spark, sf_dir).select(F.col("event_type").alias("pool"), F.expr("event_id div 8").alias("family"))


@query("w5_family_pool_split", "WITH " + _FAMILY + " SELECT pool, family, split FROM fam")
def w5_family_pool_split(spark, sf_dir):
    return sp.family_pool_split(_families(spark, sf_dir), "pool", "family")


@query(
    "j13_seed_draw",
    """WITH m AS (SELECT pool, member, row_number() OVER (PARTITION BY pool ORDER BY md5('42:' || member), member) - 1 AS slot,
    count(*) OVER (PARTITION BY pool) AS n FROM (SELECT DISTINCT event_type AS pool, user_id AS member FROM events)),
i AS (SELECT event_type AS pool, event_id AS case_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) - 1 AS position FROM events)
SELECT i.case_id, i.pool, i.position, m.member FROM i JOIN m ON m.pool = i.pool AND m.slot = i.position % m.n""",
)
def j13_seed_draw(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    items = ev.select(F.col("event_type").alias("pool"), F.col("event_id").alias("case_id"))
    members = ev.select(F.col("event_type").alias("pool"), F.col("user_id").alias("member"))
    return sp.draw_round_robin(items, "pool", "case_id", members, "member").select("case_id", "pool", "position", "member")


def in_order(df):
    """`df` with `position`, its row's place in the order the rows come out in."""
    rows = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    parts = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    firsts = parts.select("_part", before.alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)
    placed = rows.withColumn("_part", F.shiftright("_at", 33)).join(firsts, "_part")
    return placed.select(*df.columns, (F.col("_before") + inside).alias("position"))


@query("w8_grouped_shuffle", _CASES + "SELECT split, pair_id, case_id, md5('42:' || pair_id) AS shuffle_key, row_number() OVER (ORDER BY split, md5('42:' || pair_id), pair_id, case_id) - 1 AS position FROM cases")
def w8_grouped_shuffle(spark, sf_dir):
    return in_order(sp.grouped_shuffle(fx.cases(spark, sf_dir).select("split", "pair_id", "case_id"), "split", "pair_id", "case_id"))


@query("w10_sorts", _CASES + "SELECT split, cohort, case_id, row_number() OVER (ORDER BY split, cohort, case_id) - 1 AS position FROM cases")
def w10_sorts(spark, sf_dir):
    return in_order(fx.cases(spark, sf_dir).select("split", "cohort", "case_id").orderBy("split", "cohort", "case_id"))


@query(
    "d4_label_budget",
    """SELECT budget, event_id AS case_id FROM (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS pos FROM events),
  (VALUES (0), (25), (100), (350)) b(budget) WHERE pos < budget""",
)
def d4_label_budget(spark, sf_dir):
    rows = fx.events(spark, sf_dir).select(F.col("event_id").alias("case_id"))
    return sp.label_budgets(rows, "case_id").select("budget", "case_id")


@query(
    "d4_learning_curve",
    """WITH rows AS (SELECT event_id, event_type, CASE WHEN value >= 30 THEN 1 ELSE 0 END AS y, event_id % 5 = 0 AS test FROM events),
b AS (SELECT budget, event_id, event_type, y FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS pos FROM rows WHERE NOT test), (VALUES (25), (100), (350)) v(budget) WHERE pos < budget),
m AS (SELECT budget, event_type, CASE WHEN 2 * sum(y) >= count(*) THEN 1 ELSE 0 END AS predicted FROM b GROUP BY ALL),
s AS (SELECT v.budget, count(*) AS n_test, count(*) FILTER (m.predicted = r.y) AS n_right FROM (VALUES (25), (100), (350)) v(budget), (SELECT * FROM rows WHERE test) r LEFT JOIN m ON m.budget = v.budget AND m.event_type = r.event_type GROUP BY 1)
SELECT budget, (SELECT count(*) FROM b WHERE b.budget = s.budget) AS n_train, n_test, n_right, round(n_right::DOUBLE / n_test, 6) AS accuracy FROM s""",
)
def d4_learning_curve(spark, sf_dir):
    """How well the more frequent answer of each event type does, learned from ever more labels."""
    e = fx.events(spark, sf_dir).select(F.col("event_id").alias("case_id"), "event_type", F.when(F.col("value") >= 30, 1).otherwise(0).alias("y"))
    train, test = e.where("case_id % 5 <> 0"), e.where("case_id % 5 = 0")

    def majority(own, blind):
        votes = own.groupBy("event_type").agg(F.when(2 * F.sum("y") >= F.count(F.lit(1)), 1).otherwise(0).alias("predicted"))
        return blind.join(votes, "event_type")

    return sp.learning_curve(sp.label_budgets(train, "case_id", (25, 100, 350)), train, test, majority, "case_id", "y")


_PINS = ", ".join(f"('{k}', '{v}')" for k, v in fx.WRAPPER_PINS.items())


@query(
    "l5_group_holdout_flags",
    _LINT + f"""SELECT l.case_id, p.split, pin.s AS pinned_split, coalesce(pin.s <> p.split, false) AS pin_broken
FROM lint l JOIN (SELECT DISTINCT pair_id, split FROM cases WHERE cohort = 'A') p USING (pair_id) LEFT JOIN (VALUES {_PINS}) pin(w, s) ON pin.w = l.wrapper_family""",
)
def l5_group_holdout_flags(spark, sf_dir):
    parents = fx.cases(spark, sf_dir).where(F.col("cohort") == "A").select("pair_id", "split").distinct()
    return sp.pin_splits(fx.lint_cases(spark, sf_dir), parents, fx.WRAPPER_PINS).select("case_id", "split", "pinned_split", "pin_broken")


# ------------------------------------------------------------------ components and leakage
_GROUPS = """groups AS (SELECT comp, 'G-' || substr(sha256(string_agg(d, '|' ORDER BY d)), 1, 10) AS group_id
  FROM (SELECT comp, substr(m, 1, 2) AS m, sha256(string_agg(d, '|' ORDER BY d)) AS d
    FROM (SELECT comp, substr(md5(p), 1, 4) AS m, sha256(string_agg(p, '|' ORDER BY p)) AS d
      FROM (SELECT DISTINCT event_id // 40 AS comp, CAST(event_id // 5 AS VARCHAR) AS p FROM events) GROUP BY ALL) GROUP BY ALL) GROUP BY 1)"""


@query(
    "a29_group_components",
    "WITH " + _GROUPS + " SELECT DISTINCT CAST(event_id // 5 AS VARCHAR) AS pair_id, group_id FROM events JOIN groups ON comp = event_id // 40",
)
def a29_group_components(spark, sf_dir):
    return cc.group_components(fx.cases(spark, sf_dir))


@query("j8_case_to_group", "WITH " + _GROUPS + " SELECT event_id AS case_id, group_id AS cluster FROM events JOIN groups ON comp = event_id // 40")
def j8_case_to_group(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    return cc.case_groups(c, cc.group_components(c)).select("case_id", "cluster")


_LEAKS = " UNION ALL ".join(
    f"SELECT 'leak_{k}' AS rule, CAST({k} AS VARCHAR) AS key, {_SPLITS} AS detail FROM lint WHERE {k} IS NOT NULL AND CAST({k} AS VARCHAR) <> 'none' GROUP BY {k} HAVING count(DISTINCT split) > 1"
    for k in li.LEAK_KEYS
)


@query("a28_leak_check", _LINT + _LEAKS)
def a28_leak_check(spark, sf_dir):
    return li.leaks(fx.lint_cases(spark, sf_dir))


_GROUP_LEAKS = f"SELECT 'leak_group' AS rule, group_id AS key, {_SPLITS} AS detail FROM cases JOIN groups ON comp = case_id // 40 GROUP BY group_id HAVING count(DISTINCT split) > 1"


@query("a28_group_leaks", _CASES + ", " + _GROUPS + " " + _GROUP_LEAKS)
def a28_group_leaks(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    return li.group_leaks(c, cc.group_components(c))


_COVERAGE = """SELECT 'coverage_event_type' AS rule, s AS key, string_agg(t, ',' ORDER BY o) AS detail FROM (VALUES ('train'), ('val'), ('test')) ss(s),
  (VALUES ('signup', 1), ('error', 2), ('click', 3), ('view', 4), ('purchase', 5), ('telemetry', 6)) tt(t, o)
  WHERE NOT EXISTS (SELECT 1 FROM cases WHERE split = s AND gold_event_type = t) GROUP BY s
UNION ALL SELECT 'coverage_priority', s, string_agg(t, ',' ORDER BY t) FROM (VALUES ('train'), ('val'), ('test')) ss(s), (VALUES ('P1'), ('P2'), ('P3'), ('P4')) tt(t)
  WHERE NOT EXISTS (SELECT 1 FROM cases WHERE split = s AND gold_priority = t) GROUP BY s
UNION ALL SELECT 'coverage_page_now', s, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t DESC) FROM (VALUES ('train'), ('val'), ('test')) ss(s), (VALUES (true), (false)) tt(t)
  WHERE NOT EXISTS (SELECT 1 FROM cases WHERE split = s AND gold_page_now = t) GROUP BY s"""


@query("a27_coverage_check", _CASES + _COVERAGE)
def a27_coverage_check(spark, sf_dir):
    return li.coverage(fx.cases(spark, sf_dir), (*_TYPES, "telemetry"))


_PINNED = f"SELECT 'pinned_family' AS rule, w AS key, 'pinned to ' || s || ', also in ' || {_SPLITS} AS detail FROM lint JOIN (VALUES {_PINS}) pin(w, s) ON w = wrapper_family WHERE split <> s GROUP BY w, s"


@query("v14_pinned_family", _LINT + _PINNED)
def v14_pinned_family(spark, sf_dir):
    return li.pinned_families(fx.lint_cases(spark, sf_dir), fx.WRAPPER_PINS)


def _row_rules_sql() -> str:
    key = "CAST(case_id AS VARCHAR)"
    claim = f"regexp_matches(raw, '{fv.PAYLOAD_CLAIM}', 'i')"
    rules = [
        ("dataset_kind", "dataset_kind <> 'derived'", "dataset_kind"),
        ("missing_seed_source", "seed_source = ''", "'seed_source'"),
        ("foreign_ip", "raw LIKE '%10.1.2.3%'", "'10.1.2.3'"),
        ("unresolved_placeholder", "raw LIKE '%<*>%'", "'<*>'"),
        ("claim_outside_b_prime", f"cohort <> 'B_prime' AND {claim} AND slang_term IS NULL", "cohort"),
        ("b_prime_without_claim", f"cohort = 'B_prime' AND NOT {claim}", "cohort"),
        ("d_must_be_unlabeled", "cohort = 'D' AND label_status <> 'needs_adjudication'", "label_status"),
        ("must_be_rubric_derived", "cohort <> 'D' AND label_status <> 'rubric_derived'", "label_status"),
        ("label_version", "cohort <> 'D' AND label_version <> '2.4.0'", "label_version"),
        ("b_prime_lost_page", "cohort = 'B_prime' AND NOT gold_page_now", "cohort"),
    ]
    parts = [f"SELECT '{n}' AS rule, {key} AS key, {d} AS detail FROM lint WHERE {c}" for n, c, d in rules]
    for i, p in enumerate(fv.LEAK_PATTERNS):
        parts.append(f"SELECT 'answer_in_text', {key}, '{i + 1}' FROM lint WHERE cohort <> 'B_prime' AND regexp_matches(raw, '{p}', 'i')")
    terms = ", ".join(f"('{t}', '{s}')" for t, s in fx.LEXICON)
    parts.append(f"SELECT 'lexicon_term', {key}, t FROM lint, (VALUES {terms}) lex(t, s) WHERE s <> split AND contains(lower(raw), t)")
    return " UNION ALL ".join(parts)


@query("v14_row_rules", _LINT + _row_rules_sql())
def v14_row_rules(spark, sf_dir):
    return li.row_rules(fx.lint_cases(spark, sf_dir), fx.LINT_KIND, fx.LEXICON)


_LABELS = _LABEL.removeprefix("WITH ")
_RECHECK = """SELECT 'label_recheck' AS rule, CAST(case_id AS VARCHAR) AS key, CASE WHEN case_id % 97 = 0 THEN 'priority' ELSE 'rubric rejects stored case: impact not on its scale' END AS detail
  FROM label WHERE error IS NULL AND (case_id % 97 = 0 OR case_id % 89 = 0)"""


def _stored(spark, sf_dir):
    """Cases with the rubric's own labels; in some the stored priority was changed, in others the evidence."""
    cases = rb.label_nested(fx.nested_cases(spark, sf_dir)).select("case_id", "event", "context", "evidence", "label")
    c = F.col("case_id")
    label = F.when(F.col("label").isNotNull(), F.col("label").withField("priority", F.when(c % 97 == 0, "P0").otherwise(F.col("label.priority"))))
    impact = F.when((c % 89 == 0) & (c % 97 != 0), "huge").otherwise(F.col("evidence.impact"))
    return computed_once(cases.withColumn("label", label).withColumn("evidence", F.col("evidence").withField("impact", impact)), "label")


def _recheck(spark, sf_dir):
    return li.rederived(_stored(spark, sf_dir))


@query("j12_label_recheck", "WITH " + _LABELS + _RECHECK)
def j12_label_recheck(spark, sf_dir):
    """The rubric run again on every stored case."""
    return _recheck(spark, sf_dir)


@query(
    "v14_string_rules",
    """SELECT 'foreign_ip' AS rule, CAST(event_id AS VARCHAR) AS key, '10.1.2.3' AS detail FROM events WHERE event_id % 31 = 0
UNION ALL SELECT 'unresolved_placeholder', CAST(event_id AS VARCHAR), '<*>' FROM events WHERE event_id % 37 = 0
UNION ALL SELECT 'unfilled_slot', CAST(event_id AS VARCHAR), '{svc}' FROM events WHERE event_id % 41 = 0
UNION ALL SELECT 'unfilled_slot', CAST(event_id AS VARCHAR), '{user}' FROM events WHERE event_id % 41 = 0""",
)
def v14_string_rules(spark, sf_dir):
    """Addresses, placeholders and slots planted in parts of event and context that hold no log text."""
    c = F.col("case_id")
    cases = fx.nested_cases(spark, sf_dir)
    host = F.when(c % 31 == 0, "db-10.1.2.3 (was 192.0.2.1)").otherwise(F.col("context.asset.host"))
    changes = F.when(c % 41 == 0, F.array(F.get(F.col("spare"), F.lit(0)))).otherwise(F.col("context.active_changes"))
    kind = cases.schema["context"].dataType["active_changes"].dataType.simpleString()
    spare = F.expr(f"cast(array(named_struct('id', '{{svc}} by {{user}} and {{other}}', 'hosts', array('h'), 'start', null, 'end', null, 'status', 'approved', 'expected_signals', null)) AS {kind})")
    signal = F.when(c % 37 == 0, "saw <*> twice").otherwise(F.col("event.signal"))
    planted = cases.withColumn("spare", spare).withColumn("context", F.col("context").withField("asset.host", host).withField("active_changes", changes)).withColumn("event", F.col("event").withField("signal", signal))
    return li.string_rules(planted)


@query("v14_dataset_lint", _LINT.rstrip() + ", " + _GROUPS + ", " + _LABELS + " " + " UNION ALL ".join([_row_rules_sql(), _LEAKS, _GROUP_LEAKS, _PINNED, _COVERAGE, _RECHECK]))
def v14_dataset_lint(spark, sf_dir):
    """All rules over one table of the cases, written once with the columns that they read."""
    c = cut_lineage(fx.lint_cases(spark, sf_dir).drop("questions", "file_split", "label_event_type", "label_priority"))
    return li.union_violations(
        [
            li.row_rules(c, fx.LINT_KIND, fx.LEXICON),
            li.leaks(c),
            li.group_leaks(c, cc.group_components(c)),
            li.pinned_families(c, fx.WRAPPER_PINS),
            li.coverage(c, (*_TYPES, "telemetry")),
            _recheck(spark, sf_dir),
        ]
    )


@query(
    "v1_case_contract",
    _LINT + """SELECT 'split_differs_from_file' AS rule, CAST(case_id AS VARCHAR) AS key, split AS detail FROM lint WHERE split <> file_split
UNION ALL SELECT 'questions', CAST(case_id AS VARCHAR), questions FROM lint WHERE questions <> 'event_type,page_now,priority'""",
)
def v1_case_contract(spark, sf_dir):
    return li.case_contract(fx.lint_cases(spark, sf_dir))


@query(
    "v2_expected_matches_label",
    _LINT + """SELECT 'expected_differs_from_label' AS rule, CAST(case_id AS VARCHAR) AS key, cohort AS detail FROM lint WHERE gold_priority IS DISTINCT FROM label_priority""",
)
def v2_expected_matches_label(spark, sf_dir):
    return li.expected_matches_label(fx.lint_cases(spark, sf_dir))


@query(
    "v7_catalog_contract",
    """WITH t AS (SELECT doc_id AS template_id FROM labels), p AS (SELECT doc_id AS template_id, source AS pool FROM documents)
SELECT 'unknown_template' AS rule, CAST(template_id AS VARCHAR) AS key, pool AS detail FROM p WHERE template_id NOT IN (SELECT template_id FROM t)
UNION ALL SELECT 'pool_too_small', pool, CAST(count(*) AS VARCHAR) FROM p GROUP BY pool HAVING count(*) < CASE WHEN pool IN ('src1', 'src2', 'src3') THEN 60 ELSE 50 END""",
)
def v7_catalog_contract(spark, sf_dir):
    """Documents as pool members (pool = source), labeled documents as the catalog."""
    catalog = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("template_id"))
    pools = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("template_id"), F.col("source").alias("pool"), F.col("source").isin("src1", "src2", "src3").alias("pairs"))
    return li.catalog_contract(catalog, pools, min_pool=50, min_pairing=60)


@query(
    "v7_plan_contract",
    """WITH t AS (SELECT source AS topic, CASE WHEN source = 'src3' THEN 'train' ELSE CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END END AS split, split_part(text, ' ', 1) AS term FROM documents)
SELECT 'topic_without_term' AS rule, topic AS key, array_to_string(list_filter(['train', 'val', 'test'], lambda s: NOT list_contains(list(split), s)), ',') AS detail FROM t GROUP BY topic HAVING count(DISTINCT split) < 3
UNION ALL SELECT 'term_not_unique', term, CAST(count(*) AS VARCHAR) FROM t GROUP BY term HAVING count(*) > 1
UNION ALL SELECT 'no_family_held_out', 'test', 'wrapper family'""",
)
def v7_plan_contract(spark, sf_dir):
    """First words of all documents as terms of topics, one topic without held-out terms, and no wrapper family held out for the test."""
    d = fx.table(spark, sf_dir, "documents")
    split = F.when(F.col("source") == "src3", "train").otherwise(F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int")))
    terms = d.select(F.col("source").alias("topic"), split.alias("split"), F.split_part("text", F.lit(" "), F.lit(1)).alias("term"))
    families = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("val").alias("split"))
    return li.plan_contract(terms, families)


@query("j9_unknown_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9_unknown_ids(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id").join(fx.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "a26_tallies",
    _CASES + """SELECT 'total' AS tally, 'all' AS key, count(*) AS n FROM cases
UNION ALL SELECT 'by_cohort', cohort, count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'by_split', split, count(*) FROM cases GROUP BY 2
UNION ALL SELECT 'by_split_and_cohort', split || '/' || cohort, count(*) FROM cases GROUP BY 2
UNION ALL SELECT 'gold_by_event_type', gold_event_type, count(*) FROM cases WHERE gold_event_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'gold_by_priority', gold_priority, count(*) FROM cases WHERE gold_event_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'gold_by_page_now', CAST(gold_page_now AS VARCHAR), count(*) FROM cases WHERE gold_event_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'gold_by_split_priority', split || '/' || gold_priority, count(*) FROM cases WHERE gold_event_type IS NOT NULL GROUP BY 2""",
)
def a26_tallies(spark, sf_dir):
    return li.tallies(fx.cases(spark, sf_dir))


@query("j10_passages_in_text", "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text))")
def j10_passages_in_text(spark, sf_dir):
    texts = fx.texts(spark, sf_dir, "documents").select("doc_id", "text")
    passages = fx.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return tm.terms_in_text(texts, "doc_id", "text", passages, "item_id", "passage")


@query(
    "j10_short_passages",
    """WITH terms AS (SELECT DISTINCT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS term FROM benchmark)
SELECT doc_id, term FROM documents, terms WHERE length(term) > 1 AND contains(lower(text), lower(term))""",
)
def j10_short_passages(spark, sf_dir):
    """Terms of two words, which have no inner words to look up."""
    texts = fx.texts(spark, sf_dir, "documents").select("doc_id", "text")
    two = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    terms = fx.table(spark, sf_dir, "benchmark").select(two.alias("term")).distinct().where(F.length("term") > 1)
    found = tm.terms_in_text(texts, "doc_id", "text", terms.select("term", F.col("term").alias("passage")), "term", "passage")
    return found.select("doc_id", "term")
