"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from alertloom.llm import backoff, block_names, collocations, html_diff, licenses, mixing, near_join, packing, quality, quality_svm, rotated_means, token_files, url_filter
from alertloom.llm.common import table
from alertloom.session import work_path


def op1_page_text(spark, sf_dir):
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark, sf_dir):
    out = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.entries(spark))


def op5_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_rates(docs))


def op6_pattern_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_token_files(spark, sf_dir):
    path = work_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path))


def op8_backoff_score(spark, sf_dir):
    out = backoff.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), F.round("log_score_others", 4).alias("log_score_others"), "n_backoff")


def op9_ngram_jaccard_join(spark, sf_dir):
    return near_join.similar_groups(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    out = block_names.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_quality_svm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_svm.score(docs, quality_svm.learn(docs, table(spark, sf_dir, "labels")))


def op12_rotated_means(spark, sf_dir):
    return rotated_means.cluster(table(spark, sf_dir, "embeddings"))


def op13_phrase_automata(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_page_text, op2_quality_rules, op3_license_scan, op4_url_filter, op5_mix_sources, op6_pattern_packing, op7_token_files,
        op8_backoff_score, op9_ngram_jaccard_join, op10_exact_dedup, op11_quality_svm, op12_rotated_means,
        op13_phrase_automata,
    )
}

_STOP_LIST = ", ".join(f"'{form}'" for w in sorted(set(quality.STOP_WORDS)) for form in (w, w.capitalize()))

_KNOWN_ROWS = ", ".join("('%s', '%s')" % (name, text.replace("'", "''")) for name, text in licenses.KNOWN)
_SPELLED = "' ' || replace(p, chr(10), ' ' || chr(10) || ' ') || ' '"
for _a, _b in licenses.SPELLINGS:
    _SPELLED = f"replace({_SPELLED}, ' {_a} ', ' {_b} ')"

# The rule of licenses.NOTICE without look-ahead, which this SQL's patterns lack: one that must match, and one that must not.
_BEFORE = r"[^\p{{L}}\p{{N}}©(]*"
_WORDS = "notices?|holders?|owners?|owner?ship|licen[cs]es?|laws?|statements?|interests?|rights?|treaty|protection|infringement|claims?|disclaimers?|terms?|permission|and|or|in|is|are|of|to|for|as|on|under|with|shall|may"
_NOTICE = (
    rf"(regexp_matches({{0}}, '(?i)^{_BEFORE}copyright\b{_BEFORE}(?:\(c\)|©|\d{{{{4}}}}|[\[<{{{{]|by\b)') OR regexp_matches({{0}}, '(?i)^{_BEFORE}(?:©|\(c\)\s*(?:[\[<{{{{]|\d{{{{4}}}}))')"
    rf" OR (regexp_matches({{0}}, '(?i)^{_BEFORE}\(c\)\s*copyright\b') AND NOT regexp_matches({{0}}, '(?i)^{_BEFORE}\(c\)\s*copyright\s+(?:notice|holder|owner|licen[cs]e)'))"
    rf" OR (regexp_matches({{0}}, '(?i)^[^\p{{{{L}}}}\p{{{{N}}}}]*copyright\s+(?-i:\p{{{{Lu}}}})') AND NOT regexp_matches({{0}}, '(?i)^[^\p{{{{L}}}}\p{{{{N}}}}]*copyright\s+(?:{_WORDS})\b')))"
)

_ENTRIES = ", ".join([f"('{e}', '{v}', true)" for e, v in url_filter.RULES] + [f"('{e}', 'block', false)" for e in url_filter.BLOCKED])

_DISTANCES = "list_transform(c.cs, lambda c: list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT)"
_MEANS = ""
for _n in range(rotated_means.ROUNDS + 1):
    _MEANS += f"""
a{_n} AS MATERIALIZED (SELECT vec_id, v, d, list_position(d, list_min(d)) AS k FROM (SELECT vec_id, v, {_DISTANCES} AS d FROM kept, c{_n} AS c)),"""
    if _n < rotated_means.ROUNDS:
        _MEANS += f"""
s{_n} AS (SELECT k, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{_n}, generate_series(1, 64) g(i) GROUP BY ALL),
m{_n} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{_n} GROUP BY k),
c{_n + 1} AS MATERIALIZED (SELECT list(coalesce(m.c, cs[j]) ORDER BY j) AS cs FROM (SELECT cs, unnest(generate_series(1, len(cs))) AS j FROM c{_n}) LEFT JOIN m{_n} m ON m.k = j),"""

ORACLES = {
    "op12_rotated_means": f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
c0 AS MATERIALIZED (SELECT list(v ORDER BY h, v) AS cs FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT 8)),{_MEANS}
f AS (SELECT vec_id, k, d[k] AS distance FROM a{rotated_means.ROUNDS})
SELECT vec_id, (k - 1)::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(cs[k], ',')) AS centroid_sha256 FROM f, c{rotated_means.ROUNDS}""",
    "op2_quality_rules": rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS run
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT doc_id, run FROM runs GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM runs JOIN twice USING (doc_id, run), (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOP_LIST})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots
      FROM split LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1.0 * n_symbols / greatest(n_words, 1) AS sym FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_stop_words, n_lines,
       NOT base_failed AND 1.0 * word_chars / greatest(n_words, 1) BETWEEN 2 AND 12 AND sym <= 0.3 AND 1.0 * n_dup_lines / greatest(n_lines, 1) <= 0.5
       AND (n_words < 20 OR (sym <= 0.1 AND 1.0 * n_stop_words / n_words >= 0.02 AND 1.0 * bullets / n_lines <= 0.9 AND 1.0 * dots / n_lines <= 0.3)) AS kept
FROM r""",
    "op3_license_scan": rf"""
WITH texts AS (SELECT doc_id, NULL AS name, coalesce(text, '') AS t FROM documents UNION ALL SELECT NULL, * FROM (VALUES {_KNOWN_ROWS}) v),
plain AS (SELECT *, regexp_replace(replace(replace(lower(t), '©', ' copyright '), '(c)', ' copyright '), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS p FROM texts),
spelled AS (SELECT *, {_SPELLED} AS s FROM plain),
paired AS (SELECT *, string_split(s, chr(10)) AS pl, string_split(t, chr(10)) AS rl FROM spelled),
lines AS (SELECT *, list_filter(list_transform(generate_series(1, len(pl)), lambda i: CASE WHEN starts_with(trim(pl[i]), 'copyright ') AND {_NOTICE.format('rl[i]')} AND NOT regexp_matches(coalesce(rl[i - 1], ''), '{licenses.RUNS_ON}') THEN '' ELSE trim(pl[i]) END),
                 lambda x: x <> '' AND NOT starts_with(x, 'all rights reserved')) AS l FROM paired),
digests AS (SELECT doc_id, name, sha256(array_to_string(l, ' ')) AS text_digest, list_transform(l, lambda x: sha256(x)) AS line_digests FROM lines),
known AS (SELECT text_digest AS digest, min(name) AS license FROM digests WHERE name IS NOT NULL GROUP BY 1),
notices AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
            FROM (SELECT doc_id, unnest(line_digests) AS digest FROM digests WHERE name IS NULL) JOIN known USING (digest) GROUP BY 1)
SELECT d.doc_id, text_digest, license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notices
FROM digests d LEFT JOIN known ON text_digest = digest LEFT JOIN notices USING (doc_id) WHERE d.name IS NULL""",
    "op4_url_filter": f"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
entries AS (SELECT entry, verdict, is_rule, regexp_extract(entry, '^([^/]*)(.*)$', 1) AS h, regexp_extract(entry, '^([^/]*)(.*)$', 2) AS s FROM (VALUES {_ENTRIES}) v(entry, verdict, is_rule)),
fit AS (SELECT page_id, entry, verdict, is_rule FROM p, entries WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)),
best AS (SELECT page_id, arg_max(entry, length(entry)) FILTER (is_rule) AS rule, arg_max(verdict, length(entry)) FILTER (is_rule) AS verdict, bool_or(NOT is_rule) AS listed FROM fit GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN best USING (page_id)""",
    "op8_backoff_score": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, k, w[i - k + 1:i] AS g FROM (SELECT doc_id, w, k, unnest(generate_series(k, len(w))) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
own AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL), c AS MATERIALIZED (SELECT g, sum(n)::BIGINT AS c FROM own GROUP BY 1), total AS (SELECT count(*)::DOUBLE AS n FROM g WHERE k = 1),
p AS (SELECT g.doc_id, i, max(c) FILTER (k = 1) AS c1, max(c) FILTER (k = 2) AS c2, max(c) FILTER (k = 3) AS c3, max(c - n) FILTER (k = 2) AS o2, max(c - n) FILTER (k = 3) AS o3
      FROM g JOIN c ON c.g = g.g JOIN own ON own.doc_id = g.doc_id AND own.g = g.g GROUP BY ALL),
q AS (SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN c3 IS NOT NULL THEN ln(c3::DOUBLE / b2) WHEN c2 IS NOT NULL THEN ln(c2::DOUBLE / b1) ELSE ln(c1 / n) END AS s,
      CASE WHEN o3 > 0 THEN ln(o3::DOUBLE / b2) WHEN o2 > 0 THEN ln(o2::DOUBLE / b1) + CASE WHEN o3 = 0 THEN ln(0.4::DOUBLE) ELSE 0 END
           ELSE ln(c1 / n) + (CASE WHEN o3 = 0 THEN 1 ELSE 0 END + CASE WHEN o2 = 0 THEN 1 ELSE 0 END) * ln(0.4::DOUBLE) END AS o, coalesce(o3 = 0 OR (o3 IS NULL AND o2 = 0), false) AS missed FROM q, total),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (missed) AS n_backoff, sum(s) AS s, sum(o) AS o FROM s GROUP BY 1)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(s / n_words, 6) AS mean_log_score, round(coalesce(o, 0.0), 4) AS log_score_others, coalesce(n_backoff, 0)::BIGINT AS n_backoff
FROM w LEFT JOIN t USING (doc_id)""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT w.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op5_mix_sources": """
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY 1),
rates AS (SELECT source, sqrt(size::DOUBLE) / sum(sqrt(size::DOUBLE)) OVER () * sum(size) OVER () / size AS rate FROM sizes),
parts AS (SELECT source, greatest(1, ceil(rate / 8))::INT AS parts, rate / greatest(1, ceil(rate / 8)) AS mean FROM rates),
cdf AS (SELECT source, k, sum(exp(-mean) * pow(mean, k) / factorial(k::INT)::DOUBLE) OVER (PARTITION BY source ORDER BY k) AS c
        FROM parts, (SELECT unnest(generate_series(0, 32)) AS k)),
draws AS (SELECT doc_id, source, ('0x' || substr(md5('mix-1:' || doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM (SELECT doc_id, source, unnest(generate_series(1, parts)) AS j FROM documents JOIN parts USING (source))),
counted AS (SELECT doc_id, count(*)::INT AS n_copies FROM draws d JOIN cdf c ON d.source = c.source AND c.c <= d.u GROUP BY 1)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, n_copies, md5('mix-1:order:' || doc_id || ':' || copy) AS mix_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM documents JOIN counted USING (doc_id)) d""",
    "op13_phrase_automata": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT *, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000""",
    "op10_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
}
