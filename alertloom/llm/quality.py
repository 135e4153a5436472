"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import let, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui se sur un une "
    "als auf aus bei das dem den der des die ein eine er für ist mit nicht sich sie und von zu "
    "al con del el ella es esta la las lo los más no para por que se sin su un una y"
).split()

#: (measure, least, most, from how many words on); None is open. A text outside any of these is rejected.
THRESHOLDS = (
    ("n_words", 10, None, 0),
    ("mean_word_chars", 2.0, 12.0, 0),
    ("symbols_per_word", None, 0.1, 20),
    ("symbols_per_word", None, 0.3, 0),
    ("stop_word_ratio", 0.02, None, 20),
    ("dup_line_ratio", None, 0.5, 0),
    ("bullet_line_ratio", None, 0.9, 20),
    ("ellipsis_line_ratio", None, 0.3, 20),
)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in a run of `window` words that occurs at least twice in the text, first run included.

    Run hashes tell whether any run can occur twice; only then are the runs themselves sorted, so that equal
    runs lie side by side and their positions are known.
    """
    runs = F.size(tokens) - (window - 1)

    def rolling(hash_of) -> Column:
        return F.slice(F.transform(tokens, hash_of), 1, F.greatest(runs, F.lit(0)))

    hashes = rolling(lambda w, i: F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, window)]))

    def covered() -> Column:
        pairs = F.array_sort(F.transform(F.sequence(F.lit(1), runs), lambda i: F.struct(F.array_join(F.slice(tokens, i, window), " ").alias("run"), i.alias("at"))))

        def twice(run: Column, i: Column, all_runs: Column) -> Column:
            same = F.coalesce(F.get(all_runs, i + 1)["run"] == run["run"], F.lit(False))
            return F.when(same | F.coalesce((i > 0) & (F.get(all_runs, i - 1)["run"] == run["run"]), F.lit(False)), run["at"])

        places = let(pairs, lambda p: F.array_sort(F.array_compact(F.transform(p, lambda run, i: twice(run, i, p)))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(window), at - acc["last"])).alias("n"), at.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    return F.when(runs < 2, 0).otherwise(F.when(let(hashes, lambda h: F.size(h) == F.size(F.array_distinct(h))), 0).otherwise(covered())).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The counts of one text, as columns; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = let(F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
        F.size(F.filter(x, lambda line: line.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).alias("bullet"), F.size(F.filter(x, lambda line: line.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).alias("ellipsis"),
    ))
    known = [form for w in sorted(set(STOP_WORDS)) for form in (w, w.capitalize())]

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(known))).cast("long").alias("n_stop_words"),
        )

    return {"w": let(words(whole), of_words), "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"), "lines": lines}


def assess(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """`docs` without its text, with the counts, the ratios, `base_failed` and `kept`.

    A text of no words has ratios of 0 and fails. Columns of `docs` that bear the name of a measure are replaced.
    """
    counts = measures(F.col(text_col))
    rest = [c for c in docs.columns if c != text_col]
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "base_failed", "kept")
    rest = [c for c in rest if c.lower() not in own]
    one = docs.select(*rest, F.explode(F.array(F.struct(*[v.alias(k) for k, v in counts.items()]))).alias("_m"))
    raw = one.select(
        *rest, "_m.w.n_words", "_m.w.word_chars", "_m.n_symbols", F.col("_m.lines.dup").cast("long").alias("n_dup_lines"), "_m.w.n_repeat_words",
        "_m.w.n_stop_words", F.col("_m.lines.n").cast("long").alias("n_lines"), F.col("_m.lines.bullet").alias("_bullet"), F.col("_m.lines.ellipsis").alias("_ellipsis"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    ratios = {
        "mean_word_chars": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"), "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "bullet_line_ratio": ratio("_bullet", "n_lines"), "ellipsis_line_ratio": ratio("_ellipsis", "n_lines"),
    }
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for measure, least, most, from_words in thresholds:
        value = ratios.get(measure, F.col(measure))
        fits = (value >= least if least is not None else F.lit(True)) & (value <= most if most is not None else F.lit(True))
        inside = inside & ((F.col("n_words") < from_words) | fits)
    return raw.withColumns(ratios | {"base_failed": base, "kept": ~base & inside}).drop("_bullet", "_ellipsis")


def keep_good(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of `docs` whose text passes, with all columns as they were."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("_text"))
    return assess(carried, "_text", thresholds).where("kept").select("row.*")


