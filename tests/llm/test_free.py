"""Operators with Python inside tasks, against brute force in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alertloom.llm import backoff, html_diff, near_join, packing, shingles, token_files, tokens, url_filter
from alertloom.llm.common import find_package
from alertloom.llm.html_blocks import blocks
from alertloom.llm.signature_tree import SignatureTree

WORD_BPE, BYTE_BPE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = "ab Zé\n\t  \xa0\u2009\u3000'sΣσß9½.<|endoftext|>,!\u0301\x1c\x85İ漢 \r\x0b\u200b😀"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", " ", "a <|endoftext|> b", "<|startoftext|>x  y \n\n z", "one", "b " * 9000, "word " * 3]
    out += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    pool = [f"w{i}" for i in range(40)]
    for _ in range(12):
        base = rng.choices(pool, k=rng.randrange(20, 90))
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            near = list(base)
            for _ in range(rng.randrange(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(pool)
            out.append("\n".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    find_package(spark)
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, id string, name string, shingles string").repartition(5)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_piecewise_ids_are_those_of_the_whole_text(texts, path):
    whole = Tokenizer.from_file(path)
    ids, bounds = tokens.encode_texts(pa.array(texts), path, 7)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 7], repr(t)


def test_worker_forgets_and_goes_on(texts, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    coder = tokens.PieceEncoder(BYTE_BPE)
    monkeypatch.setattr(tokens, "encoder", lambda path: coder)
    test_piecewise_ids_are_those_of_the_whole_text(texts, BYTE_BPE)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4097, 3000), rng.integers(2000, 4097, 500), np.ones(5000, int), np.array([4096] * 7 + [1]), np.zeros(0, int), np.clip(rng.normal(900, 150, 4000).astype(int), 1, 4096)):
        histogram = Counter(lengths.tolist())
        places = []
        for n, first, end, sequence, offset, times in packing.Plan(histogram).slots():
            places += [(sequence + (r - first) // times, offset + (r - first) % times * n, n) for r in range(first, end)]
        assert Counter(n for _, _, n in places) == histogram
        places.sort()
        for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
            assert (s2 == s and o2 == o + n) or (s2 > s and o2 == 0)
            assert o + n <= 4096


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((6, 15)), rng.normal(size=6)
        x = packing.least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert x.min() >= 0 and slope.max() < 1e-6 and abs(slope * x).max() < 1e-6


def test_packing(spark, docs, texts):
    whole = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(docs, WORD_BPE, with_ids=True).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want |= {(i, k): (k * 4096, ids[k * 4096 : (k + 1) * 4096]) for k in range(-(-len(ids) // 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.ids) for r in rows} == want and len(rows) == len(want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack_documents(docs.limit(0), WORD_BPE).count() == 0


def test_packing_when_the_scan_is_split_anew(spark, tmp_path, monkeypatch):
    path, key = str(tmp_path / "pieces"), "spark.sql.files.maxPartitionBytes"
    spark.range(20_000).select("id", (F.col("id") * 7919 % 4000 + 1).alias("length")).repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    plan, before = packing.Plan, spark.conf.get(key)

    def later(*args):  # after counting, before ranking
        spark.conf.set(key, "8k")
        return plan(*args)

    monkeypatch.setattr(packing, "Plan", later)
    try:
        rows = packing.pack(spark.read.parquet(path)).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(r.id for r in rows) == list(range(20_000))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length


def test_packing_fails_if_a_piece_has_no_place(spark, monkeypatch):
    plan = packing.Plan

    class Short(plan):
        def slots(self):
            return super().slots()[:-1]

    monkeypatch.setattr(packing, "Plan", Short)
    with pytest.raises(RuntimeError, match="placed"):
        packing.pack(spark.range(100).withColumn("length", F.col("id") + 1)).count()


def test_token_files(spark, docs, texts, tmp_path):
    whole = Tokenizer.from_file(BYTE_BPE)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, BYTE_BPE, file_bytes=4000, group_bytes=1 << 16)
    got = token_files.read_tokens(spark, path).orderBy("doc_id").collect()
    start = 0
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].doc_id, got[i].start, got[i].n_tokens, got[i].ids) == (i, start, len(ids), ids)
        start += len(ids)
    sums = token_files.checksums(token_files.read_tokens(spark, path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in sums} == {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    plan = token_files.read_tokens(spark, path, with_ids=False)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ReadSchema: [^\n]*ids", plan) and sum(1 for _ in (tmp_path / "tokens").glob("part-*")) > 1
    token_files.write_tokens(docs.limit(0), path + "-none", BYTE_BPE)
    assert token_files.read_tokens(spark, path + "-none").count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff(spark, docs, texts, monkeypatch, order):
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 3000)
    got = {r.doc_id: r for r in backoff.score(docs, order=order, table_bytes=2000).collect()}
    tokens_of = {i: words(t) for i, t in enumerate(texts)}
    grams = lambda v: Counter(tuple(v[i : i + k]) for k in range(1, order + 1) for i in range(len(v) - k + 1))
    count = Counter()
    for v in tokens_of.values():
        count.update(grams(v))
    n = sum(len(v) for v in tokens_of.values())
    assert len(got) == len(texts)
    for i, v in tokens_of.items():
        own, score, others, missed = grams(v), 0.0, 0.0, 0
        for at in range(len(v)):
            longest = min(order, at + 1)
            g = tuple(v[at - longest + 1 : at + 1])
            score += math.log(count[g] / (count[g[:-1]] if len(g) > 1 else n))
            steps = 0
            while len(g) > 1 and count[g] == own[g]:
                g, steps = g[1:], steps + 1
            others += math.log(0.4) * steps + math.log((count[g] - own[g]) / count[g[:-1]] if len(g) > 1 else count[g] / n)
            missed += steps > 0
        r = got[i]
        assert (r.n_words, r.n_backoff) == (len(v), missed), texts[i]
        assert r.log_score == pytest.approx(score) and r.log_score_others == pytest.approx(others)
        assert r.mean_log_score == (pytest.approx(score / len(v)) if v else None)


def test_backoff_edge_cases(spark, docs):
    find_package(spark)
    assert backoff.score(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([("x", "a b"), ("x", "a b"), (None, "A\tb"), ("y", None), ("y", "")], "doc_id string, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.log_score, 6)) for r in backoff.score(rows).collect())
    assert got == [("None", 2, 0, round(math.log(0.5), 6)), ("x", 2, 0, round(math.log(0.5), 6)), ("x", 2, 0, round(math.log(0.5), 6)), ("y", 0, 0, 0.0), ("y", 0, 0, 0.0)]
    values = np.array([0, 1, 1 << 40, (1 << 56) - 1], np.uint64)
    assert (backoff.unpack_sorted(backoff.pack_sorted(values)) == values).all()
    assert all((backoff.unpack_counts(backoff.pack_counts(np.array(v, np.int64))) == v).all() for v in ([], [1, 2], [1, 70_000], [5, 1 << 40]))


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(sets)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("tree_sets", [4096, 2])
def test_near_join(spark, docs, texts, tree_sets):
    got = near_join.similar_groups(docs, tree_sets=tree_sets).collect()
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)
    assert len({c for _, c in want.values()}) < len(texts)


def test_near_join_edge_cases(spark, docs, texts):
    kept = near_join.one_of_each(docs)
    want = {i for i, (_, c) in brute_components(texts).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    assert near_join.similar_groups(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "A b\tc d e f"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_join.similar_groups(rows).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 3), (4, 2, 3), (3, 2, 3), (9, 0, 9)], key=str)


def test_signature_tree_on_random_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 300):
        base = [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.concatenate([b[rng.random(30) > 0.1], rng.integers(0, 2**63, rng.integers(1, 4)).astype(np.uint64)])) for b in (base[rng.integers(4)] for _ in range(n))]
        got = SignatureTree(sets, 64).groups().tolist()
        parent = list(range(n))

        def top(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(n):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    parent[top(i)] = top(j)
        assert len(set(zip(got, map(top, range(n)), strict=True))) == len(set(got)) == len(set(map(top, range(n))))


def test_shingles_are_those_of_the_words(texts):
    found = {}
    for t, s in zip(texts, shingles.shingle_sets(pa.array(texts)), strict=True):
        w = words(t)
        want = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        assert len(s) == len(want) and found.setdefault(want, s.tolist()) == s.tolist()


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar">{}</body>'


def test_blocks():
    page = PAGE.format(
        '<header><h1>Site</h1></header><nav><a>m</a></nav><main><article><header><h1>T &amp; &lt;x&#233;</h1></header><p title="a>b">a<br>b \n c<i>d</i><ul><li>one<li>two</ul>'
        '<div class="ad-box">buy</div><aside>s</aside><section id="comments"><p>c</p></section></article></main><form>f</form><div id=cookie-notice>k</div><footer>z</footer>'
    )
    assert [b.text for b in blocks(page) if b.inside and not b.outside] == ["T & <xé", "a b cd", "one", "two"]
    assert {b.text for b in blocks(page) if b.outside} == {"Site", "m", "buy", "s", "c", "f", "k", "z"}
    assert blocks("") == [] and [b.text for b in blocks("plain &am; <3 text")] == ["plain &am; <3 text"] and blocks("<p>" * 50) == []


def test_names_inside_an_article():
    kept = "<h2 id='related-work'>a</h2><section id='navigation'>b</section><section id='notices'><p>c</p></section><table class='share-price'><tr><td>d</table>"
    kept += "<div class='social-science'>e</div><p>f <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math></p>"
    gone = "<div class='share-buttons'>g</div><div class='related-posts'>h</div><div id='comments'>i</div><div class='newsletter'>j</div>"
    for tag in ("article", "main", "article class='post ad-free'"):
        found = blocks(f"<{tag}>{kept}{gone}</{tag.split()[0]}><div class='share-price'>k</div>")
        assert [b.text for b in found if b.inside and not b.outside] == ["a", "b", "c", "d", "e", "f x=2"]
        assert {b.text for b in found if b.outside} == {"g", "h", "i", "j", "k"}


def test_shared_positions():
    rng = random.Random(4)
    for t in range(400):
        a, b = ([rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randrange(0, 150 if t % 40 == 0 else 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_diff.shared_positions(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_page_differencing(spark):
    find_package(spark)
    boiler = ["<p>Welcome to our site</p>", "<p>About us - Imprint - Jobs</p>"]
    rows = [(i, f"http://h.example/{'en' if i % 2 else 'de'}/{i:03d}", PAGE.format(f"{boiler[0]}<p>Story number {i}</p><p>more on {i}</p>{boiler[1]}")) for i in range(30)]
    rows += [(100, "http://copy.example/a", PAGE.format("<p>x1</p><p>x2</p>")), (101, "http://copy.example/b", PAGE.format("<p>x1</p><p>x2</p>"))]
    rows += [(200, "http://art.example/a", PAGE.format("<article><p>same</p><p>one</p></article><p>menu</p>")), (201, "http://art.example/b", PAGE.format("<article><p>same</p><p>two</p></article><p>menu</p>"))]
    rows += [(300, None, PAGE.format("<p>alone</p>")), (301, "no host", None), (302, "http://x.example/", ""), (303, "http://y.example", PAGE.format("<p>only</p>")), (303, "http://y.example", PAGE.format("<p>only</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    got = html_diff.extract(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(text[i] == f"Story number {i}\n\nmore on {i}" for i in range(30))
    assert text[100] == text[101] == "x1\n\nx2" and (text[200], text[201]) == ("same\n\none", "same\n\ntwo")
    assert (text[300], text[301], text[302], text[303]) == ("alone", "", "", "only") and all(r.n_chars == len(r.text) for r in got)
    assert html_diff.extract(df.limit(0)).count() == 0


def test_differencing_by_query_past_copies_and_of_short_articles(spark):
    find_package(spark)
    top, end = [f"<p>menu {k}</p>" for k in range(9)], "<p>Imprint</p>"
    page = lambda *story: PAGE.format("".join(top) + "".join(f"<p>{x}</p>" for x in story) + end)
    rows = [(i, f"http://q.example/index.php?id={i}", page(f"story {i}")) for i in range(6)]
    rows += [(10 + i, f"http://p.example/{i}", page(*(f"text {i} {k}" for k in range(30)))) for i in range(4)]
    rows += [(20 + i, f"http://p.example/{i}?print=1", PAGE.format("".join(f"<p>text {i} {k}</p>" for k in range(30)) + "<p>printed</p>")) for i in range(1)]
    rows += [(30, "http://two.example/a", page("short a")), (31, "http://two.example/b", page("short b"))]
    rows += [(40, "http://prints.example/a", page("x1", "x2")), (41, "http://prints.example/a?print=1", PAGE.format("<p>x1</p><p>x2</p>"))]
    text = {r.page_id: r.text for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(text[i] == f"story {i}" for i in range(6)) and (text[30], text[31]) == ("short a", "short b")
    assert all(text[10 + i] == "\n\n".join(f"text {i} {k}" for k in range(30)) for i in range(4))
    assert all("x1\n\nx2" in text[k] for k in (40, 41))


def test_differencing_inside_articles(spark):
    find_package(spark)
    page = lambda i: PAGE.format(f"<main><p>We moved</p><p>story {i}</p><p>{'a quote' if i < 2 else 'own words'}{i // 2}</p><p>Subscribe</p></main>")
    rows = [(i, f"http://m.example/{i}", page(i)) for i in range(6)]
    got = html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"story {i}\n\n{'a quote' if i < 2 else 'own words'}{i // 2}" for i in range(6)}
    assert all(r.n_shared == 2 for r in got)


def test_the_same_page_under_two_hosts(spark):
    find_package(spark)
    page = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    one = page(["shared on a", "my own story", "more of it"])
    rows = [(1, "http://a.example/1", one), (1, "http://b.example/1", one)] + [(k, f"http://a.example/{k}", page(["shared on a", f"story {k}", f"end {k}"])) for k in range(2, 6)]
    got = {(r.page_id, r.url): r.text for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1, "http://a.example/1"] == "my own story\n\nmore of it"
    assert got[1, "http://b.example/1"] == "shared on a\n\nmy own story\n\nmore of it"  # alone on its host


def test_sites_without_markup(spark):
    """Hundreds of pages in plain paragraphs: sections with templates of their own, rotating teasers, copies, and quotes of other articles."""
    find_package(spark)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(4, 14)))
    rows, truth, quotes = [], {}, 0
    for site in range(3):
        top, bottom = [line() for _ in range(rng.randrange(4, 9))], [line() for _ in range(rng.randrange(3, 8))]
        sections = {s: [line() for _ in range(3)] for s in "xyz"}
        said = []
        for k in range(120):
            section = rng.choice("xyz")
            article = [line() for _ in range(rng.randrange(4, 25))]
            if said and rng.random() < 0.2:
                article.insert(rng.randrange(len(article)), rng.choice(rng.choice(said)))
                quotes += 1
            said.append(article)
            body = top + sections[section] + article + bottom
            for copy in range(2 if rng.random() < 0.05 else 1):
                page_id = len(rows)
                rows.append((page_id, f"http://s{site}.example/{section}/{k:04d}{'/print' * copy}", "<html><body>" + "".join(f"<p>{x}</p>" for x in body) + "</body></html>"))
                truth[page_id] = article
    out = html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kept = right = wanted = 0
    for r in out:
        have, want = r.text.split("\n\n") if r.text else [], truth[r.page_id]
        both = sum((Counter(have) & Counter(want)).values())
        kept, right, wanted = kept + len(have), right + both, wanted + len(want)
    assert len(out) == len(rows) > 360 and quotes > 50
    assert right / kept >= 0.9 and right / wanted >= 0.99  # template left over; article lines lost, quoted ones included
    assert sum(r.n_shared for r in out) > 0.8 * sum(r.n_lines - len(truth[r.page_id]) for r in out)


def test_url_filter(spark):
    find_package(spark)
    rng = random.Random(6)
    names = ["net", "example.net", "a.example.net", "EXAMPLE.com", "x.example.com", "badexample.net", "org", "b.org", "casino-win.example.org", "s.free-bets.example.com", "é.org", ""]
    urls = [None, "", "none", "://", "http://", "ftp://a://b.net/en/"] + [f"http{rng.choice(['', 's'])}://{rng.choice(names)}{rng.choice(['', '/', '/en/', '/en', '/de/x', '/fr/1?q=/en/', '#/fr/', '?a', '/EN/', '/en/a/b'])}" for _ in range(300)]
    rules = [*url_filter.RULES, ("example.net/en/a", "block")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("clash")), url_filter.entries(spark, rules)).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")

        def fits(entry, host=host, path=path):
            h, _, p = entry.partition("/")
            return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

        best = max((r for r in rules if fits(r[0])), key=lambda r: len(r[0]), default=None)
        verdict = best[1] if best else "block" if any(map(fits, url_filter.BLOCKED)) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[0], verdict), u
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.entries(spark)).count() == 0
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), url_filter.entries(spark).limit(0)).first().verdict == "allow"


def test_digest_collisions_do_not_count():
    digests = np.array([5, 5, 5, 9], dtype=np.int64)
    found = url_filter.search_sorted(digests, ["a", "b", "c", "d"], np.array([5, 5, 9, 1], dtype=np.int64), ["c", "z", "d", "a"])
    assert sorted(zip(*found, strict=True)) == [(0, 2), (2, 3)]
