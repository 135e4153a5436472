"""Which texts contain which passages: by one automaton of all passages, or, for more than can be sent to the tasks, by an
equi-join on a rare shingle followed by an exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators import automaton

WORD = r"[a-z0-9]+"
SHINGLE = 3
#: Characters in a run by which a short passage is found.
GRAM = 4


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _shingles(words: Column) -> Column:
    """All runs of three words. Built by zipping shifted arrays: a lambda that refers back to `words`
    would evaluate the whole text again for every position."""
    n = F.size(words)

    def shifted(by: int) -> Column:
        return F.slice(words, F.lit(by + 1), F.greatest(n - (SHINGLE - 1), F.lit(0)))

    out = shifted(0)
    for by in range(1, SHINGLE):
        out = F.zip_with(out, shifted(by), lambda a, b: F.concat_ws(" ", a, b))
    return out


def _held(texts: DataFrame, text_id: str, pieces: Column, wanted: DataFrame) -> DataFrame:
    return texts.select(text_id, F.explode(F.array_distinct(pieces)).alias("piece")).join(wanted.select("piece").distinct(), "piece", "left_semi")


def _checked(texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, held: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each passage meets only the texts that hold its rarest piece, and is looked for in those."""
    freq = held.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    anchors = pieces.join(freq, "piece", "left").groupBy(passage_id).agg(F.min_by("piece", F.struct(F.coalesce("df", F.lit(0)), "piece")).alias("piece"))
    pairs = held.join(anchors, "piece").select(text_id, passage_id)
    both = pairs.join(texts.select(text_id, F.lower(text).alias("_t")), text_id).join(passages.select(passage_id, F.lower(passage).alias("_p")), passage_id)
    return both.where(F.col("_t").contains(F.col("_p"))).select(text_id, passage_id)


def passages_in_text(texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str) -> DataFrame:
    """(text_id, passage_id) where the lowercased passage is a substring of the lowercased text.

    A passage's inner words (all but the first and last, which a text may extend) stand whole in any text that contains
    it, so each inner shingle must occur there; passages of fewer than five words have none and are found by runs of four
    characters, or fewer if they are shorter. The piece found in the fewest texts is the passage's anchor; only texts
    holding the anchor are checked, by exact containment. An empty passage is in no text.
    """
    counted = passages.select(passage_id, passage, _words(F.col(passage)).alias("w")).where(F.length(passage) > 0)
    long = counted.where(F.size("w") >= SHINGLE + 2)
    inner = F.slice(F.col("w"), F.lit(2), F.size("w") - 2)
    shingles = long.select(passage_id, F.explode(F.array_distinct(_shingles(inner))).alias("piece"))
    held = _held(texts, text_id, _shingles(_words(F.col(text))), shingles)
    out = _checked(texts, text_id, text, long, passage_id, passage, held, shingles)
    short = counted.where(F.size("w") < SHINGLE + 2).withColumn("k", F.least(F.length(passage), F.lit(GRAM)))
    for k in [r["k"] for r in short.select("k").distinct().collect()]:  # at most GRAM lengths

        def grams(c: Column, k: int = k) -> Column:
            return F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(.{%d}))" % k), F.lit(1))

        those = short.where(F.col("k") == k)
        pieces = those.select(passage_id, F.explode(F.array_distinct(grams(F.col(passage)))).alias("piece"))
        out = out.unionByName(_checked(texts, text_id, text, those, passage_id, passage, _held(texts, text_id, grams(F.col(text)), pieces), pieces))
    return out


def terms_in_text(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term_id: str, term: str) -> DataFrame:
    """(text_id, term_id) where the lowercased term is a substring of the lowercased text.

    A list whose automata have a checked, bounded size is looked for in one pass over the texts, without a shuffle; a longer
    one by `passages_in_text`.
    """
    found = automaton.scan(texts, text_id, text, terms, term_id, term) if automaton.fits(terms, term) else None
    return passages_in_text(texts, text_id, text, terms, term_id, term) if found is None else found
