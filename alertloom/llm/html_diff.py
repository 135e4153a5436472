"""Main text of pages by differencing each with the page of the nearest URL on its host.

Pages of a site share menus, headers, notices and other boilerplate; their articles differ. The different pages of each host
are sorted by path and query, and each is compared with up to NEAR pages on either side: lines are aligned by their longest
common subsequence. Lines that many of them share are taken for template. A page that has the rest of the lines too is a
copy (a print version, say) and tells nothing; the lines shared with the nearest page that is none are deleted, and the
template. Lines marked as menu, header, footer, sidebar, notice, advert, form or comments go even if no other page has them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alertloom.llm.common import url_host, url_place
from alertloom.llm.html_blocks import Block, blocks
from alertloom.session import cut_lineage, release

#: What markup says of a line.
FREE, INSIDE, OUTSIDE = 0, 1, 2
#: Pages compared on either side, and pages of a host that are compared in one task.
NEAR = 8
CHUNK = 64
#: Articles quote each other: a line marked as article is boilerplate only if so many other pages have it.
INSIDE_PAGES = 2


def shared_positions(a: list, b: list) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`.

    Rows of the usual table are kept as bits of one integer. Only every k-th row is stored and the rows between are made
    again on the way back, so memory is that of a few thousand rows however long the pages are.
    """
    common = set(a) & set(b)
    rows = [i for i, x in enumerate(a) if x in common]
    other = [x for x in b if x in common]
    if not rows:
        return []
    full = (1 << len(other)) - 1
    bits: dict = {}
    for j, x in enumerate(other):
        bits[x] = bits.get(x, 0) | 1 << j

    def after(v: int, i: int) -> int:
        u = v & bits[a[rows[i]]]
        return ((v + u) | (v - u)) & full

    step = max(64, int(len(rows) ** 0.5) + 1)
    v, saved = full, []
    for i in range(len(rows)):
        if i % step == 0:
            saved.append(v)
        v = after(v, i)
    out, j, upto = [], len(other), len(rows)
    for block in range(len(saved) - 1, -1, -1):
        base = block * step
        states = [saved[block]]
        for i in range(base, upto):
            states.append(after(states[-1], i))
        i = upto
        while i > base and j:
            if states[i - base] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if i == 0 or states[i - base] >> (j - 1) & 1:
                out.append(rows[i])
                j -= 1
        upto = base
    return out[::-1]


def deletions(own: list, kinds: list, others: list[list]) -> list[int]:
    """Positions of the lines of a page that are boilerplate by what other pages, the nearest first, share.

    `kinds` has OUTSIDE for lines that markup drops anyway; those that the nearest page or most pages share count as found here
    too. Template is what more than half of the others share, or a quarter and
    three at least. Another page is a copy if it has all (or more than half) of the other lines, or has no others of its own.
    Lines that markup calls article go only if INSIDE_PAGES and two thirds of the pages that are no copies share them.
    """
    free = {i for i, kind in enumerate(kinds) if kind != OUTSIDE}
    met = [set(shared_positions(own, other)) for other in others]
    shared = [free & some for some in met]
    times = Counter(i for some in shared for i in some)
    need = min(len(others) // 2 + 1, max(3, -(-len(others) // 4)), max(min(2, len(others)), *times.values(), 0))
    template = {i for i in free if times[i] >= need} if times else set()
    rest = free - template
    known = {own[i] for i in template} | {x for x, kind in zip(own, kinds, strict=True) if kind == OUTSIDE}

    def is_copy(other: list, some: set[int]) -> bool:
        theirs = {x for x in other if x not in known}
        return 2 * len(rest & some) > len(rest) or rest <= some or theirs <= {own[i] for i in some}

    telling = [k for k, (other, some) in enumerate(zip(others, shared, strict=True)) if not is_copy(other, some)]
    if not telling:
        return []
    nearest = met[telling[0]]
    pages = Counter(i for k in telling for i in shared[k])
    several = {i for i, n in pages.items() if n >= INSIDE_PAGES and 3 * n >= 2 * len(telling)}
    all_times = Counter(i for some in met for i in some)
    outside = {i for i in all_times if i not in free and (i in nearest or 2 * all_times[i] > len(others))}
    return sorted(outside | {i for i in free if (i in several if kinds[i] == INSIDE else i in nearest or i in template)})


def page_lines(found: list[Block]) -> tuple[list[int], list[int]]:
    """A 64-bit hash of each line, and what markup says of it."""
    return [xxhash.xxh64_intdigest(b.text) - (1 << 63) for b in found], [OUTSIDE if b.outside else INSIDE if b.inside else FREE for b in found]


def line_table(pages: DataFrame) -> DataFrame:
    """(id, version, host, path, look, lines, kinds) of every page; `version` tells pages with one id apart, `look` is a digest of the last two."""
    schema = T.StructType([pages.schema["id"], pages.schema["version"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType())])
    schema = schema.add("look", "binary").add("lines", T.ArrayType(T.LongType(), False)).add("kinds", T.ArrayType(T.ByteType(), False))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [page_lines(blocks(page or "")) for page in batch.column("html").to_pylist()]
            looks = [xxhash.xxh3_128_digest(np.array(x, "<i8").tobytes() + bytes(k)) for x, k in both]
            keys = [batch.column(c) for c in ("id", "version", "host", "path")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(looks, pa.binary()), pa.array([x for x, _ in both], pa.list_(pa.int64())), pa.array([k for _, k in both], pa.list_(pa.int8()))], names=schema.names)

    return pages.select("id", "version", "host", "path", "html").mapInArrow(lines, schema)


def common_prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def shared_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, look, gone): the deletions of each different page of a host that has any; and the table to release.

    Different pages are put in one global order and numbered, so that a host of any size is spread over all tasks. A task
    compares CHUNK of them, with copies of the NEAR before and after.
    """
    one = lines.groupBy("host", "look").agg(F.min(F.struct("path", "id", "version")).alias("at"), F.first("lines").alias("lines"), F.first("kinds").alias("kinds"))
    one = one.select("host", F.col("at.path").alias("path"), F.col("at.id").alias("id"), "look", "lines", "kinds")
    order = ("host", "path", "id", "look")
    ordered = cut_lineage(one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()))
    part = F.shiftright("n", 33)
    sizes = ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("rows"))  # one row per partition
    firsts = sizes.select("p", F.coalesce(F.sum("rows").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    at = ordered.withColumn("p", part).join(F.broadcast(firsts), "p").withColumn("pos", F.col("first") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))
    chunk = lambda shift: F.floor((F.col("pos") + F.lit(shift)) / F.lit(CHUNK)).cast("long")
    dealt = at.select("host", "path", "look", "lines", "kinds", "pos", F.explode(F.array_distinct(F.array(chunk(0), chunk(-NEAR), chunk(NEAR)))).alias("chunk"))
    schema = T.StructType().add("host", "string").add("look", "binary").add("gone", T.ArrayType(T.IntegerType()))

    def compare(group: pa.Table) -> pa.Table:
        pages = sorted(group.to_pylist(), key=lambda page: page["pos"])
        out = []
        for k, page in enumerate(pages):
            if page["pos"] // CHUNK != page["chunk"]:
                continue
            near = [(j, pages[j]) for j in range(max(0, k - NEAR), min(len(pages), k + NEAR + 1)) if j != k and pages[j]["host"] == page["host"]]
            near.sort(key=lambda x: (-common_prefix(page["path"], x[1]["path"]), abs(x[0] - k), x[0]))
            if gone := deletions(page["lines"], page["kinds"], [other["lines"] for _, other in near]):
                out.append({"host": page["host"], "look": page["look"], "gone": gone})
        return pa.Table.from_pylist(out, pa.schema([("host", pa.string()), ("look", pa.binary()), ("gone", pa.list_(pa.int32()))]))

    return dealt.groupBy("chunk").applyInArrow(compare, schema), ordered


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text, n_chars, `n_lines` of the page and `n_shared`, those found
    shared, whether markup would have dropped them or not.

    Null or empty html gives empty text. A page without URL, or alone on its host, has no partner and is judged by markup
    alone. Where a page marks an article, its text is what stands in it, else all of it, each without what markup or differencing
    removes. Pages of a host with the same lines count as one page in comparing. Other columns are not read.
    """
    host, path = url_host(F.col(url_col)), url_place(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(html_col).alias("version"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    lines = cut_lineage(line_table(slim.where("html IS NOT NULL AND host <> ''")))
    found, ordered = shared_lines(lines)
    of = lines.select(F.col("id").alias("of"), F.col("version").alias("v"), "host", "look")
    named = of.join(found, ["host", "look"]).select("of", "v", F.col("host").alias("h"), "gone")
    gone = cut_lineage(named.dropDuplicates(["of", "v", "h"]))  # equal pages of a host lose the same lines
    release(lines, ordered)
    schema = T.StructType([T.StructField(id_col, slim.schema["id"].dataType), T.StructField(url_col, T.StringType())])
    schema = schema.add("text", "string").add("n_chars", "long").add("n_lines", "long").add("n_shared", "long")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, deleted = [], [], []
            for page, drop in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                found = blocks(page or "")
                dropped = set(drop or ())
                whole = any(b.inside and not b.outside for b in found)
                texts.append("\n\n".join(b.text for k, b in enumerate(found) if not b.outside and k not in dropped and (b.inside or not whole)))
                counts.append(len(found))
                deleted.append(len(dropped))
            sizes = pa.array(np.array([len(t) for t in texts], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), sizes, pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())], names=schema.names)

    both = slim.join(gone, slim["id"].eqNullSafe(gone["of"]) & (slim["version"] == gone["v"]) & (slim["host"] == gone["h"]), "left")
    return both.select("id", "url", "html", "gone").mapInArrow(assemble, schema)
