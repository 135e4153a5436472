"""Registered text queries: templates, placeholders, de-identification, scans, threads, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom import fixtures as fx
from alertloom.functions import pseudonyms as ps
from alertloom.functions import text as tx
from alertloom.operators import counterfactuals as cf
from alertloom.operators import deid
from alertloom.operators import lint as li
from alertloom.operators import rendering as rd
from alertloom.operators import templates as tp
from alertloom.operators import thread_deid as td
from alertloom.operators import threads as th

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_LOGS = fx.sql_with("logs")


def extracted(spark, sf_dir):
    return tp.extract(fx.log_lines(spark, sf_dir))


@query("a30_template_mining", _LOGS + "SELECT source, source_file, system, template_id, template, n_lines FROM registry")
def a30_template_mining(spark, sf_dir):
    return tp.first_templates(extracted(spark, sf_dir))


@query("s7_template_registry", _LOGS + "SELECT source, source_file, system, template_id, template, n_lines, kinds AS placeholder_kinds, length(kinds) - length(replace(kinds, ',', '')) + 1 AS num_placeholders FROM registry")
def s7_template_registry(spark, sf_dir):
    r = tp.registry(extracted(spark, sf_dir))
    return r.withColumn("placeholder_kinds", F.array_join("placeholder_kinds", ","))


@query(
    "a30_file_counters",
    _LOGS + """SELECT 'src' AS source, file, count(*) AS seen, count(*) FILTER (kind = 'none') AS skipped_unparsed,
  count(*) FILTER (kind = 'degenerate') AS skipped_degenerate, coalesce(any_value(k.n), 0) AS templates,
  count(*) FILTER (kind NOT IN ('none', 'degenerate')) - coalesce(any_value(k.n), 0) AS duplicates, count(*) FILTER (kind NOT IN ('none', 'degenerate')) = 0 AS empty
FROM shape LEFT JOIN (SELECT source_file AS file, count(*) AS n FROM registry GROUP BY 1) k USING (file) GROUP BY file""",
)
def a30_file_counters(spark, sf_dir):
    return tp.file_counters(extracted(spark, sf_dir))


@query(
    "p8_normalize_log_body",
    _LOGS + "SELECT event_id AS line_no, coalesce(template, '<*> <*>') AS template FROM shape LEFT JOIN tpl USING (kind) WHERE kind <> 'none'",
)
def p8_normalize_log_body(spark, sf_dir):
    return extracted(spark, sf_dir).where(F.col("template").isNotNull()).select("line_no", "template")


@query("p9_split_syslog", _LOGS + "SELECT event_id AS line_no, CASE WHEN kind = 'degenerate' THEN 'syslog' ELSE system END AS system, CASE WHEN kind = 'degenerate' THEN 'app' ELSE slug END AS slug FROM shape LEFT JOIN tpl USING (kind)")
def p9_split_syslog(spark, sf_dir):
    return tp.syslog_lines(fx.log_lines(spark, sf_dir)).select("line_no", "system", "slug")


@query("p8_document_templates")
def p8_document_templates(spark, sf_dir):
    """Whole document lines as bodies: every line of every document becomes a template."""
    lines = fx.texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "body"))
    return tp.normalize(lines, "body").groupBy("template").agg(F.count(F.lit(1)).alias("n_lines"))


@query("v12_assert_no_ip", _LOGS + "SELECT template || ' from 10.1.2.3' AS template FROM registry WHERE length(template) % 2 = 0 UNION ALL SELECT template FROM registry WHERE length(template) % 2 = 1 AND regexp_matches(template, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')")
def v12_assert_no_ip(spark, sf_dir):
    """Planted: an address in every template of even length."""
    mined = tp.first_templates(extracted(spark, sf_dir)).select("template")
    planted = F.when(F.length("template") % 2 == 0, F.concat("template", F.lit(" from 10.1.2.3"))).otherwise(F.col("template"))
    return tp.address_violations(mined.select(planted.alias("template")))


@query("v13_informative_filter", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (len(regexp_extract_all(line, '[A-Za-z]{2,}')) >= 2) AS informative, count(*) AS n FROM l GROUP BY 1""")
def v13_informative_filter(spark, sf_dir):
    lines = fx.texts(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(tx.is_informative(F.col("line"))).alias("informative"), F.count(F.lit(1)).alias("n"))


@query("a31_placeholder_histogram", _LOGS + "SELECT kind, count(*) AS n FROM (SELECT unnest(string_split(kinds, ',')) AS kind FROM registry) GROUP BY 1")
def a31_placeholder_histogram(spark, sf_dir):
    return tp.placeholder_histogram(tp.registry(extracted(spark, sf_dir)))


@query("a31_counts_by_system", _LOGS + "SELECT source, system, count(*) AS n FROM registry GROUP BY ALL")
def a31_counts_by_system(spark, sf_dir):
    return tp.first_templates(extracted(spark, sf_dir)).groupBy("source", "system").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p12_classify_placeholders",
    _LOGS + "SELECT event_id AS line_no, coalesce(kinds, 'number,number') AS kinds FROM shape LEFT JOIN tpl USING (kind) WHERE kind <> 'none'",
)
def p12_classify_placeholders(spark, sf_dir):
    lines = extracted(spark, sf_dir).where(F.col("template").isNotNull())
    return lines.select("line_no", F.array_join(tx.placeholder_kinds(F.col("template")), ",").alias("kinds"))


@query("p10_slug", """SELECT doc_id, CASE WHEN s = '' THEN 'msg' ELSE s END AS slug FROM (
  SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24) AS s FROM documents)""")
def p10_slug(spark, sf_dir):
    return fx.texts(spark, sf_dir, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("p11_template_id", """SELECT page_id, 'pages-' || CASE WHEN s = '' THEN 'msg' ELSE s END || '-' || substr(sha256('web' || chr(0) || html), 1, 8) AS template_id FROM (
  SELECT page_id, html, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24) AS s FROM pages)""")
def p11_template_id(spark, sf_dir):
    return fx.texts(spark, sf_dir, "pages").select("page_id", tx.template_id(F.lit("pages"), tx.slug(F.col("url")), F.lit("web"), F.col("html")).alias("template_id"))


@query("p15_lexical_tokens", "SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(t, ' ') AS joined FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def p15_lexical_tokens(spark, sf_dir):
    d = fx.texts(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_join("t", " ").alias("joined"))


@query("p20_token_substitute", "SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' on ' || user_id AS filled FROM events")
def p20_token_substitute(spark, sf_dir):
    ev = fx.events(spark, sf_dir).select("event_id", "user_id", "event_type", F.lit("user {who} did {what} on {who}").alias("pattern"))
    return tp.substitute_tokens(ev, "pattern", {"who": "user_id", "what": "event_type"}).select("event_id", "filled")


@query("p18_ts_parse", "SELECT event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS with_offset, NULL::BIGINT AS naive FROM events")
def p18_ts_parse(spark, sf_dir):
    """The same instant as text with and without an offset: the naive form must not parse."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return fx.events(spark, sf_dir).select(
        "event_id",
        F.unix_timestamp(th.parse_ts(F.concat(iso, F.lit("Z")))).alias("with_offset"),
        F.unix_timestamp(th.parse_ts(iso)).alias("naive"),
    )


@query("p19_ordinal_rank", fx.sql_with("evidence") + "SELECT case_id, list_position(['none', 'low', 'moderate', 'high'], impact) AS impact_rank, list_position(['none', 'deferred', 'same_day', 'immediate'], urgency) AS urgency_rank FROM evidence")
def p19_ordinal_rank(spark, sf_dir):
    from alertloom.operators.rubric import impact_rank, urgency_rank

    return fx.evidence(spark, sf_dir).select("case_id", impact_rank(F.col("impact")).alias("impact_rank"), urgency_rank(F.col("urgency")).alias("urgency_rank"))


# ------------------------------------------------------------------ scans over whole texts
#: One wording per pattern, planted in the document whose id leaves that remainder.
_LEAKING = ("a security_event", "a service outage", "said page_now", "page the on-call", "do not escalate", "contain immediately", "no action needed")
_PLANTED = "(SELECT doc_id, text || CASE doc_id % 50 " + " ".join(f"WHEN {i} THEN ' {p}'" for i, p in enumerate(_LEAKING)) + " ELSE '' END AS text FROM documents)"
_LEAK_CASES = " ".join(f"UNION ALL SELECT doc_id, {i + 1} FROM {_PLANTED} WHERE regexp_matches(text, '{p}', 'i')" for i, p in enumerate(fv.LEAK_PATTERNS))


@query("v8_leak_lint_text", "SELECT doc_id, pattern FROM (" + _LEAK_CASES.replace("UNION ALL ", "", 1).replace("SELECT doc_id, 1 ", "SELECT doc_id, 1 AS pattern ", 1) + ")")
def v8_leak_lint_text(spark, sf_dir):
    added = F.coalesce(F.try_element_at(F.array(*[F.lit(" " + p) for p in _LEAKING]), (F.col("doc_id") % 50 + 1).cast("int")), F.lit(""))
    planted = fx.texts(spark, sf_dir, "documents").select("doc_id", F.concat("text", added).alias("text"))
    return planted.select("doc_id", F.explode(li.leak_names(F.col("text"))).alias("pattern"))


_CLAIMS = " UNION ALL ".join(
    "SELECT conv_id, turn, role, '{}' AS pattern, false AS verified FROM chat WHERE regexp_matches(text, '{}', 'i')".format(n, p.replace("'", "''")) for n, p in fv.CLAIM_PATTERNS
)


@query("v9_claim_scan", fx.sql_with("chat") + _CLAIMS)
def v9_claim_scan(spark, sf_dir):
    return th.claims(fx.chat_messages(spark, sf_dir))


@query("v10_residue_scan")
def v10_residue_scan(spark, sf_dir):
    """Identifying categories in the raw texts of all documents and pages, before any rewriting."""
    docs = fx.texts(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = fx.texts(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("origin", "id", F.explode(deid.residue(F.col("text"))).alias("category"))


@query("v11_ip_safety", """WITH ip AS (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^0-9.])([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})', 2)) AS ip FROM documents)
SELECT doc_id, ip FROM ip WHERE split_part(ip, '.', 1)::INT <= 255 AND split_part(ip, '.', 2)::INT <= 255 AND split_part(ip, '.', 3)::INT <= 255
  AND split_part(ip, '.', 4)::INT <= 255 AND NOT (ip LIKE '192.0.2.%' OR ip LIKE '198.51.100.%' OR ip LIKE '203.0.113.%')""")
def v11_ip_safety(spark, sf_dir):
    return fx.texts(spark, sf_dir, "documents").select("doc_id", F.explode(li.foreign_ips(F.col("text"))).alias("ip"))


# ------------------------------------------------------------------ de-identification
@query("p13_deidentify_text")
def p13_deidentify_text(spark, sf_dir):
    """Whole documents rewritten; residue is reported per row instead of stopping the job."""
    out = deid.deidentify(fx.texts(spark, sf_dir, "documents").select("doc_id", "text"), "text", fx.SALT, strict=False)
    return out.select("doc_id", "text", F.size("deid_hits").alias("n_hits"), F.array_join("residue", ",").alias("residue"))


@query("d11_deidentify_pages")
def d11_deidentify_pages(spark, sf_dir):
    out = deid.deidentify(fx.texts(spark, sf_dir, "pages").select("page_id", "html"), "html", fx.SALT, strict=False)
    return out.select("page_id", "html", F.size("deid_hits").alias("n_hits"), F.array_join("residue", ",").alias("residue"))


@query("a32_deid_report")
def a32_deid_report(spark, sf_dir):
    return deid.report(deid.deidentify(fx.texts(spark, sf_dir, "documents").select("doc_id", "text"), "text", fx.SALT, strict=False))


_D = "sha256('" + fx.SALT + "' || chr(31) || '{}' || chr(31) || {})"


@query(
    "p14_pseudonym",
    f"""WITH d AS (SELECT event_id, {_D.format('user', "lower(trim('U' || user_id))")} AS u, {_D.format('email', "lower('U' || user_id || '@x.io')")} AS e,
  {_D.format('host', "lower('H' || user_id)")} AS h, {_D.format('ipv4', "'10.0.0.' || user_id")} AS v4, {_D.format('ipv6', "lower('FE80::' || user_id)")} AS v6 FROM events)
SELECT event_id, 'user-' || substr(u, 1, 8) AS user_name, 'user-' || substr(e, 1, 8) || '@example.com' AS email, 'host-' || substr(h, 1, 8) || '.example.net' AS host,
  ['192.0.2', '198.51.100', '203.0.113'][(('0x' || substr(v4, 1, 2))::INT % 3) + 1] || '.' || (1 + ('0x' || substr(v4, 3, 2))::INT % 254) AS ipv4,
  '2001:db8::' || substr(v6, 1, 4) AS ipv6 FROM d""",
)
def p14_pseudonym(spark, sf_dir):
    u = F.col("user_id").cast("string")
    return fx.events(spark, sf_dir).select(
        "event_id",
        ps.user(fx.SALT, F.concat(F.lit("U"), u)).alias("user_name"),
        ps.email(fx.SALT, F.concat(F.lit("U"), u, F.lit("@x.io"))).alias("email"),
        ps.host(fx.SALT, F.concat(F.lit("H"), u)).alias("host"),
        ps.ipv4(fx.SALT, F.concat(F.lit("10.0.0."), u)).alias("ipv4"),
        ps.ipv6(fx.SALT, F.concat(F.lit("FE80::"), u)).alias("ipv6"),
    )


# ------------------------------------------------------------------ threads
_CHAT = fx.sql_with("chat")
_KEEP, _CHARS = 3, 300


@query("w1_ts_monotonic", _CHAT + "SELECT conv_id, turn FROM (SELECT conv_id, turn, ts_sec, lag(ts_sec) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM chat) WHERE ts_sec < p")
def w1_ts_monotonic(spark, sf_dir):
    return th.ts_violations(fx.chat_messages(spark, sf_dir))


@query(
    "v3_thread_contract",
    _CHAT + """SELECT conv_id, turn, 'unknown_role' AS rule FROM chat WHERE role = 'system'
UNION ALL SELECT conv_id, turn, 'ts_needs_offset' FROM chat WHERE turn % 3 = 2 UNION ALL SELECT conv_id, turn, 'empty_text' FROM chat WHERE trim(text) = ''
UNION ALL SELECT conv_id, turn, 'author_is_not_a_pseudonym' FROM chat WHERE conv_id % 10 = 0""",
)
def v3_thread_contract(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = fx.chat_messages(spark, sf_dir).select(
        "conv_id", "turn", "role", "text", "ref_kind", "ref_id",
        F.when(F.col("turn") % 3 == 2, iso).otherwise(F.concat(iso, F.lit("Z"))).alias("ts_text"),
        F.when(F.col("conv_id") % 10 == 0, F.col("raw_author")).otherwise(ps.user(fx.SALT, F.col("raw_author"))).alias("author"),
        F.lit("team_channel").alias("channel_kind"),
    )
    return th.message_contract(m, roles=("user", "assistant"))


_CAPPED = f""", capped AS (SELECT *, length(text) > {_CHARS} AS was_cut FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM chat) WHERE r <= {_KEEP})"""


def capped_messages(spark, sf_dir):
    m = fx.chat_messages(spark, sf_dir).withColumn("author", ps.user(fx.SALT, F.col("raw_author")))
    return th.cap_threads(m, max_messages=_KEEP, max_chars=_CHARS)


@query("w2_thread_cap", _CHAT.rstrip() + _CAPPED + f" SELECT conv_id, turn, role, substr(text, 1, {_CHARS}) AS text, was_cut FROM capped")
def w2_thread_cap(spark, sf_dir):
    return capped_messages(spark, sf_dir).select("conv_id", "turn", "role", "text", "was_cut")


@query(
    "w2_thread_counters",
    _CHAT.rstrip() + _CAPPED + """ SELECT conv_id, original_message_count, messages_kept, messages_cut, original_message_count - messages_kept AS messages_dropped
FROM (SELECT conv_id, count(*) AS original_message_count FROM chat GROUP BY 1) JOIN (SELECT conv_id, count(*) AS messages_kept, count(*) FILTER (was_cut) AS messages_cut FROM capped GROUP BY 1) USING (conv_id)""",
)
def w2_thread_counters(spark, sf_dir):
    return th.thread_counters(fx.chat_messages(spark, sf_dir), capped_messages(spark, sf_dir))


def whole_threads(spark, sf_dir):
    return th.assemble(fx.chat_messages(spark, sf_dir).withColumn("author", ps.user(fx.SALT, F.col("raw_author"))))


@query(
    "w3_assemble_thread",
    _CHAT + f"""SELECT conv_id, (turn // {th.PART_TURNS})::INT AS part, count(*) AS n_messages, string_agg(role || ':' || text, '|' ORDER BY turn) AS thread_text FROM chat GROUP BY ALL""",
)
def w3_assemble_thread(spark, sf_dir):
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")
    return whole_threads(spark, sf_dir).select("conv_id", "part", F.size("messages").alias("n_messages"), text.alias("thread_text"))


_RAW = """, raw AS (SELECT conv_id, turn, role, raw_author AS author, 'room ' || (conv_id % 7) AS channel, text AS said, text || CASE turn % 4
    WHEN 0 THEN ' Ask Person ' || (conv_id % 50) || ' USER, not node-' || (conv_id + 1) || '.' WHEN 1 THEN ' See node-' || conv_id || ' and 10.1.2.' || (conv_id % 200) || ' here.'
    WHEN 2 THEN ' Mail p' || conv_id || '@corp.org or @p' || conv_id || ' password=s3cret' || conv_id || ' now.' ELSE ' See 192.0.2.7 again.' END AS text,
  'person ' || (conv_id % 50) || ' user' AS asked, bool_or(role = 'user') OVER (PARTITION BY conv_id) AS knows_user FROM chat),
named AS (SELECT *, 'user-' || substr(USER_AUTHOR, 1, 8) AS who, CASE turn % 4
    WHEN 0 THEN said || ' Ask ' || CASE WHEN knows_user THEN 'user-' || substr(USER_ASKED, 1, 8) ELSE 'Person ' || (conv_id % 50) || ' USER' END || ', not node-' || (conv_id + 1) || '.'
    WHEN 1 THEN said || ' See host-' || substr(HOST_NODE, 1, 8) || '.example.net and ' || ['192.0.2', '198.51.100', '203.0.113'][(('0x' || substr(V4, 1, 2))::INT % 3) + 1] || '.' || (1 + ('0x' || substr(V4, 3, 2))::INT % 254) || ' here.'
    WHEN 2 THEN said || ' Mail user-' || substr(MAIL, 1, 8) || '@example.com or @user-' || substr(MENTION, 1, 8) || ' password=[REDACTED_SECRET] now.' ELSE text END AS clean FROM raw)"""
for _name, _kind, _value in (("USER_AUTHOR", "user", "lower(author)"), ("USER_ASKED", "user", "asked"), ("HOST_NODE", "host", "'node-' || conv_id"), ("V4", "ipv4", "'10.1.2.' || (conv_id % 200)"), ("MAIL", "email", "'p' || conv_id || '@corp.org'"), ("MENTION", "user", "'p' || conv_id")):
    _RAW = _RAW.replace(_name + ",", _D.format(_kind, _value) + ",")
_THREAD = "'thread-' || substr(" + _D.format("thread", "conv_id::VARCHAR") + ", 1, 8)"
_ROOM = "'channel-' || substr(" + _D.format("channel", "channel") + ", 1, 8)"


def clean_threads(spark, sf_dir):
    return td.deidentify_threads(fx.raw_threads(spark, sf_dir), fx.thread_names(spark, sf_dir), fx.SALT, max_messages=_KEEP, max_chars=_CHARS)


@query(
    "p13_threads",
    _CHAT.rstrip() + _RAW + f""" SELECT {_THREAD} AS thread, {_ROOM} AS channel, turn, role, who AS author, substr(clean, 1, {_CHARS}) AS text, length(clean) > {_CHARS} AS was_cut
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM named) WHERE r <= {_KEEP}""",
)
def p13_threads(spark, sf_dir):
    """Whole threads rewritten by their own names, authors and labels included, then capped."""
    kept, _, _ = clean_threads(spark, sf_dir)
    return kept.select(F.col("conv_id").alias("thread"), "channel", "turn", "role", "author", "text", "was_cut")


@query(
    "a32_thread_report",
    _CHAT.rstrip() + _RAW + f""", hits AS (SELECT conv_id, 'author' AS category, who AS pseudonym FROM named
  UNION ALL SELECT conv_id, 'username', asked FROM named WHERE turn % 4 = 0 AND knows_user UNION ALL SELECT conv_id, unnest(['hostname', 'ipv4']), 'x' FROM named WHERE turn % 4 = 1
  UNION ALL SELECT conv_id, unnest(['email', 'username']), 'p' FROM named WHERE turn % 4 = 2 UNION ALL SELECT conv_id, 'secret:key_value', NULL FROM named WHERE turn % 4 = 2)
SELECT {_THREAD} AS thread, category, count(*) AS occurrences, count(DISTINCT pseudonym) AS distinct_pseudonyms FROM hits GROUP BY ALL""",
)
def a32_thread_report(spark, sf_dir):
    """What was replaced in each thread, over all its messages."""
    _, report, _ = clean_threads(spark, sf_dir)
    return report.withColumnRenamed("conv_id", "thread")


@query(
    "v10_thread_residue",
    _CHAT.rstrip() + _RAW + """ SELECT conv_id, turn, unnest(CASE turn % 4 WHEN 1 THEN ['ipv4'] ELSE ['email', 'secret:key_value'] END) AS category FROM raw WHERE turn % 4 IN (1, 2)""",
)
def v10_thread_residue(spark, sf_dir):
    """Identifying categories of the raw messages, before any rewriting."""
    return fx.raw_threads(spark, sf_dir).select("conv_id", "turn", F.explode(deid.residue(F.col("text"))).alias("category"))


def _refs(spark, sf_dir):
    return fx.chat_messages(spark, sf_dir).select("conv_id", "ref_kind", "ref_id").where("ref_id IS NOT NULL").distinct()


def _structured_ids(spark, sf_dir):
    a = fx.changes(spark, sf_dir).select(F.concat(F.lit("INC-"), F.col("change_id")).alias("id"))
    b = fx.incidents(spark, sf_dir).select(F.concat(F.lit("INC-"), F.col("incident_id")).alias("id"))
    return a.union(b)


_IDS = ", ids AS (SELECT 'INC-' || change_id AS id FROM changes UNION SELECT 'INC-' || incident_id FROM incidents)"


@query("j7_event_ref_exists", fx.sql_with("changes", "incidents", "chat").rstrip() + _IDS + " SELECT DISTINCT conv_id, ref_kind, ref_id FROM chat WHERE ref_id IN (SELECT id FROM ids)")
def j7_event_ref_exists(spark, sf_dir):
    return _refs(spark, sf_dir).join(_structured_ids(spark, sf_dir).withColumnRenamed("id", "ref_id"), "ref_id", "left_semi").select("conv_id", "ref_kind", "ref_id")


@query(
    "p7_thread_to_case",
    fx.sql_with("changes", "incidents", "chat").rstrip() + _IDS + ", parts AS (SELECT *, (turn // %d)::INT AS part FROM chat), cl AS (" % th.PART_TURNS + _CLAIMS + """)
SELECT conv_id, part, count(*) AS n_messages, min_by(ts_sec, turn) AS first_ts, any_value(ref_id) AS ref_id, coalesce(bool_or(ref_id IN (SELECT id FROM ids)), false) AS event_ref_found,
  (SELECT count(*) FROM cl WHERE cl.conv_id = parts.conv_id AND cl.turn // %d = parts.part) AS n_claims FROM parts GROUP BY conv_id, part""" % th.PART_TURNS,
)
def p7_thread_to_case(spark, sf_dir):
    t = th.to_cases(whole_threads(spark, sf_dir), _refs(spark, sf_dir), _structured_ids(spark, sf_dir))
    return t.select(
        "conv_id", "part", F.size("event.messages").alias("n_messages"), F.unix_timestamp("event.ts").alias("first_ts"), "meta.ref_id",
        "meta.event_ref_found", F.size("meta.unverified_claims").alias("n_claims"),
    )


@query(
    "p7_case_context",
    fx.sql_with("evidence", "changes", "incidents", "chat").rstrip() + _CAPPED + """, k AS (SELECT conv_id, count(*) AS kept, count(*) FILTER (was_cut) AS cut, min_by(ts_sec, turn) AS first_ts FROM capped GROUP BY 1),
n AS (SELECT conv_id, count(*) AS total FROM chat GROUP BY 1)
SELECT k.conv_id, CASE WHEN k.conv_id % 2 = 0 THEN 'team_channel' ELSE 'incident_bridge' END AS channel_kind, first_ts, kept AS n_messages, total - kept AS truncated_messages, cut AS truncated_chars_messages, e.host,
  (SELECT count(*) FROM changes c WHERE c.host = e.host AND e.ts BETWEEN c.start_ts AND c.end_ts) AS n_changes, (SELECT count(*) FROM incidents i WHERE i.entity = e.host AND e.ts > i.opened AND e.ts <= i.end_ts) AS n_incidents
FROM k JOIN n USING (conv_id) JOIN evidence e ON e.case_id = k.conv_id""",
)
def p7_case_context(spark, sf_dir):
    """Capped threads as whole cases: channel, counters of what the caps took, and the context of their event."""
    kept = capped_messages(spark, sf_dir)
    counters = th.thread_counters(fx.chat_messages(spark, sf_dir), kept)
    context = fx.nested_cases(spark, sf_dir).select(F.col("case_id").alias("conv_id"), "context")
    kind = F.when(F.col("conv_id") % 2 == 0, "team_channel").otherwise("incident_bridge").alias("channel_kind")
    about = counters.join(context, "conv_id").select("conv_id", kind, F.col("messages_dropped").alias("truncated_messages"), F.col("messages_cut").alias("truncated_chars_messages"), "context")
    whole = th.assemble(kept, part_turns=1 << 20)
    t = th.to_cases(whole, _refs(spark, sf_dir), _structured_ids(spark, sf_dir), about=about)
    return t.select(
        "conv_id", "event.channel_kind", F.unix_timestamp("event.ts").alias("first_ts"), F.size("event.messages").alias("n_messages"), "meta.truncated_messages", "meta.truncated_chars_messages",
        "context.asset.host", F.size("context.active_changes").alias("n_changes"), F.size("context.active_incidents").alias("n_incidents"),
    )


# ------------------------------------------------------------------ rendering
_STATE = """SELECT event_id AS case_id, 'EVENT format=event' || chr(10) || event_type || chr(10) || 'EVENT FIELDS {"host":"' || user_id || '","signal":"' || event_type || '","ts":"'
  || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' || chr(10) || 'CONTEXT {"active_changes":[],"active_incidents":[],"asset":{"criticality":"low","host":"' || user_id || '"}}' AS state FROM events"""


@query("p2_render_state", _STATE)
def p2_render_state(spark, sf_dir):
    cases = cf.to_nested(fx.evidence(spark, sf_dir))
    return cases.select("case_id", rd.render_state(cases.schema).alias("state"))


@query(
    "p2_render_window",
    """SELECT event_id AS case_id, 'EVENT format=event' || chr(10) || event_type || CASE event_id % 3 WHEN 1 THEN chr(10) || 'before ' || event_id WHEN 2 THEN chr(10) || 'a' || chr(10) || 'b' ELSE '' END || chr(10)
  || 'EVENT FIELDS {"host":"' || user_id || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' || chr(10)
  || 'CONTEXT {"active_changes":[{"end":"e","expected_signals":[{"max_impact":"low","signal":"s"}],"hosts":["h"],"id":"C1"}],"asset":{"criticality":"low","host":"' || user_id || '"}}' AS state FROM events""",
)
def p2_render_window(spark, sf_dir):
    """Cases with window lines and a change, the signal hidden."""
    c = F.col("case_id")
    window = F.when(c % 3 == 1, F.array(F.concat(F.lit("before "), c.cast("string")))).when(c % 3 == 2, F.array(F.lit("a"), F.lit("b")))
    change = F.expr("array(named_struct('id', 'C1', 'hosts', array('h'), 'end', 'e', 'expected_signals', array(named_struct('signal', 's', 'max_impact', 'low'))))")
    nested = cf.to_nested(fx.evidence(spark, sf_dir))
    cases = nested.withColumn("event", F.col("event").withField("window", window)).withColumn("context", F.struct("context.asset", change.alias("active_changes")))
    return cases.select("case_id", rd.render_state(cases.schema, include_signal=False).alias("state"))


def _call_cases(spark, sf_dir):
    gold = fx.cases(spark, sf_dir).select("case_id", "cohort", "pair_id", "gold_event_type", "gold_page_now", "gold_priority")
    return cf.to_nested(fx.evidence(spark, sf_dir)).join(gold, "case_id")


_CALLS = fx.sql_with("cases") + """SELECT case_id, pair_id, adversarial, task, kind, n_options, target FROM (
  SELECT case_id, pair_id, cohort, cohort = 'B_prime' AS adversarial, 'event_type' AS task, 'choice' AS kind, 6 AS n_options, gold_event_type AS target FROM cases
  UNION ALL SELECT case_id, pair_id, cohort, cohort = 'B_prime', 'page_now', 'noul', 0, CAST(gold_page_now AS VARCHAR) FROM cases
  UNION ALL SELECT case_id, pair_id, cohort, cohort = 'B_prime', 'priority', 'score', 0, CASE gold_priority WHEN 'P1' THEN '87.5' WHEN 'P2' THEN '62.5' WHEN 'P3' THEN '37.5' ELSE '12.5' END FROM cases)
WHERE cohort <> 'D'"""


@query("p3_to_task_calls", _CALLS)
def p3_to_task_calls(spark, sf_dir):
    graded = _call_cases(spark, sf_dir).where(F.col("cohort") != "D")
    return rd.to_task_calls(graded, with_target=True).select("case_id", "pair_id", "adversarial", "task", "kind", F.size("options").alias("n_options"), "target")


@query(
    "d13_over_length",
    "SELECT case_id, task, 'unsupported' AS status FROM (" + _STATE + ") s, (VALUES ('event_type'), ('page_now'), ('priority')) t(task) WHERE length(state) > 192",
)
def d13_over_length(spark, sf_dir):
    calls = rd.to_task_calls(_call_cases(spark, sf_dir), with_target=False)
    return rd.mark_over_length(calls, 192)[1].select("case_id", "task", "status")


def score_by_signal(call: dict) -> dict:
    """A small deterministic candidate: reads the signal out of the rendered state."""
    from alertloom.operators.scoring import SchemaFailure, Unsupported

    signal = call["state"].split('"signal":"')[1].split('"')[0]
    case_id = int(call["case_id"])
    if case_id % 41 == 0:
        raise Unsupported("cannot do this call")
    if case_id % 43 == 0:
        raise SchemaFailure("bad output")
    if case_id % 47 == 0:
        raise RuntimeError("backend down")
    if call["task"] == "event_type":
        return {"choice": "service_degradation" if signal == "error" else "telemetry"}
    if call["task"] == "page_now":
        return {"prob": 1.5 if case_id % 53 == 0 else 0.75 if signal == "error" else 0.25}
    return {"score": 80.0 if signal == "error" else 10.0}


@query(
    "x1_batch_score",
    """SELECT 'signal' AS candidate, event_id AS case_id, task,
  CASE WHEN task = 'priority' OR event_id % 41 = 0 THEN 'unsupported' WHEN event_id % 43 = 0 THEN 'schema_failure' WHEN event_id % 47 = 0 THEN 'exception'
    WHEN task = 'page_now' AND event_id % 53 = 0 THEN 'schema_failure' ELSE 'ok' END AS status,
  CASE WHEN task = 'event_type' AND event_id % 41 <> 0 AND event_id % 43 <> 0 AND event_id % 47 <> 0 THEN CASE WHEN event_type = 'error' THEN 'service_degradation' ELSE 'telemetry' END END AS value_type,
  CASE WHEN task = 'page_now' AND event_id % 41 <> 0 AND event_id % 43 <> 0 AND event_id % 47 <> 0 AND event_id % 53 <> 0 THEN event_type = 'error' END AS value_page
FROM events, (VALUES ('event_type'), ('page_now'), ('priority')) t(task)""",
)
def x1_batch_score(spark, sf_dir):
    from alertloom.operators.scoring import batch_score

    calls = rd.to_task_calls(_call_cases(spark, sf_dir), with_target=False)
    return batch_score(calls, "signal", score_by_signal, supported=("event_type", "page_now")).select("candidate", "case_id", "task", "status", "value_type", "value_page")


def load_scorer():
    """The same candidate for whole batches; a call it refuses fails its batch, as a real backend would."""
    return lambda batch: [score_by_signal(call) for call in batch.to_pylist()]


@query("x1_batch_score_arrow", ORACLES["x1_batch_score"])
def x1_batch_score_arrow(spark, sf_dir):
    from alertloom.operators.scoring import batch_score_arrow

    calls = rd.to_task_calls(_call_cases(spark, sf_dir), with_target=False)
    return batch_score_arrow(calls, "signal", load_scorer, supported=("event_type", "page_now")).select("candidate", "case_id", "task", "status", "value_type", "value_page")


@query(
    "v6_result_contract",
    fx.sql_with("outcomes") + """SELECT candidate, task, count(*) FILTER (bad) AS broken, count(*) AS n FROM (
  SELECT candidate, task, CASE task WHEN 'event_type' THEN value_type = 'view' WHEN 'page_now' THEN case_id % 31 = 0 ELSE case_id % 37 = 0 END AS bad FROM outcomes WHERE status = 'ok') GROUP BY ALL""",
)
def v6_result_contract(spark, sf_dir):
    """Recorded results checked again, some pushed out of range and one choice left out of the options."""
    from alertloom.operators.scoring import result_error

    o = fx.outcomes(spark, sf_dir).where(F.col("status") == "ok")
    raw = o.select(
        "candidate", "task", "case_id", F.col("value_type").alias("choice"),
        F.array(*[F.lit(x) for x in ("signup", "error", "click", "purchase")]).alias("options"),
        F.lit(None).cast("map<string,double>").alias("choice_probs"),
        F.when(F.col("case_id") % 37 == 0, F.col("raw_score") + 101).otherwise(F.col("raw_score")).alias("score"),
        F.when(F.col("case_id") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("probability")).alias("prob"),
    )
    return raw.groupBy("candidate", "task").agg(F.count_if(result_error().isNotNull()).alias("broken"), F.count(F.lit(1)).alias("n"))
