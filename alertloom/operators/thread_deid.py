"""De-identification of whole threads, each by its own people and hosts.

The names of a thread are rows of a dictionary, not a pattern list of the job: after the rules that hold for any text, each
message is taken apart into words, and these meet the first words of its thread's names in a join. So a message only ever
carries the names that may stand in it, however many people a thread has, and no list is sent to the tasks. Caps come last,
so that none can cut a secret in half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions import pseudonyms as ps
from alertloom.functions.text import unicode
from alertloom.operators import deid
from alertloom.operators import threads as th
from alertloom.operators.barrier import computed_once
from alertloom.session import cut_lineage

#: What a word of a name or text is; names stand between characters that are none of these.
WORD = unicode(r"[\w-]+")
USER, HOST = "username", "hostname"
#: Shortest name.
LEAST = 3


def _first_word(name: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(name, WORD, 0), F.lit("")))


def dictionary(names: DataFrame, salt: str, thread: str = "conv_id") -> DataFrame:
    """(thread, word, category, name, pseudonym) of `names` (thread, category, name), each name once.

    A name has LEAST characters or more; a shorter one stops the job. Null names are left out.
    """
    name = F.trim("name")
    checked = F.when(F.length(name) < LEAST, F.raise_error(F.lit(f"known names need at least {LEAST} characters"))).otherwise(name)
    tidy = names.where("name IS NOT NULL").select(thread, "category", checked.alias("name")).groupBy(thread, "category", F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    pseudonym = F.when(F.col("category") == HOST, ps.host(salt, F.col("name"))).otherwise(ps.user(salt, F.col("name")))
    return tidy.select(thread, _first_word(F.col("name")).alias("word"), "category", "name", pseudonym.alias("pseudonym"))


def _apply(text: Column, hits: Column, names: Column) -> Column:
    """Struct (text, hits) after all names of the array, users first, then hosts, the longest first of each."""
    def one(state: Column, n: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)(?i)(?<![\w-])\Q"), F.replace(n["name"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\w-])"))
        found = F.regexp_count(state["text"], pattern)
        more = F.array_repeat(F.struct(n["category"].alias("category"), n["pseudonym"].alias("pseudonym")), found)
        return F.struct(F.regexp_replace(state["text"], pattern, n["pseudonym"]).alias("text"), F.concat(state["hits"], more).alias("hits"))

    return F.aggregate(names, F.struct(text.alias("text"), hits.alias("hits")), one)


def deidentify_messages(messages: DataFrame, names: DataFrame, salt: str, thread: str = "conv_id", text: str = "text", strict: bool = True) -> DataFrame:
    """Rewrite `text` by the rules for any text and then by the names of its thread; add `deid_hits` and `residue`.

    `names` is (thread, category, name), category `username` or `hostname`. A name of one thread means nothing in another.
    Null texts stay null. With `strict`, residue stops the job and names categories only.
    """
    plain = deid.deidentify(messages, text, salt, strict=False).withColumn("_row", F.monotonically_increasing_id())
    plain = cut_lineage(plain)  # keeps the row numbers, and the rewriting is done once
    known = dictionary(names, salt, thread)
    words = F.array_union(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))), F.array(F.lit("")))
    spoken = plain.where(F.col(text).isNotNull()).select(F.col(thread).alias("_of"), "_row", F.explode(words).alias("_word"))
    met = spoken.join(known, (F.col("_of") == F.col(thread)) & (F.col("_word") == F.col("word")))
    ranked = F.struct((F.col("category") == HOST).alias("later"), (-F.length("name")).alias("shorter"), "name", "category", "pseudonym")
    per = met.groupBy("_row").agg(F.sort_array(F.collect_set(ranked)).alias("_names")).withColumnRenamed("_row", "_at")
    both = plain.join(per, plain["_row"] == per["_at"], "left")
    done = both.withColumn("_done", F.when(F.col("_names").isNotNull(), _apply(F.col(text), F.col("deid_hits"), F.col("_names"))))
    done = computed_once(done, "_done").withColumn(text, F.coalesce("_done.text", text)).withColumn("deid_hits", F.coalesce("_done.hits", "deid_hits"))
    done = done.withColumn("residue", F.when(F.col("_names").isNotNull(), deid.residue(F.col(text))).otherwise(F.col("residue"))).drop("_names", "_done", "_row", "_at")
    if strict:
        done = computed_once(done, text, "residue")
        stop = F.raise_error(F.concat(F.lit("identifying text is left: "), F.array_join("residue", ","))).cast("string")
        done = done.withColumn(text, F.when(F.size("residue") > 0, stop).otherwise(F.col(text)))
    return done


def deidentify_threads(
    messages: DataFrame, names: DataFrame, salt: str, thread: str = "conv_id", channel: str = "channel", author: str = "author", turn: str = "turn", text: str = "text",
    max_messages: int = fv.MAX_MESSAGES_PER_THREAD, max_chars: int = fv.MAX_MESSAGE_CHARS, strict: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages kept, report, and counters of raw threads.

    Every message is rewritten, its author made a pseudonym, and thread and channel are named by a digest; then the last
    `max_messages` of a thread are kept and their texts cut. The report counts occurrences and different pseudonyms per thread
    and category over all messages, dropped ones too; originals are nowhere in it. Blank authors or texts stop the job.
    """
    def needed(column: str) -> Column:
        return F.when(F.coalesce(F.trim(column), F.lit("")) == "", F.raise_error(F.lit(f"{column} must not be empty"))).otherwise(F.col(column))

    sound = messages.withColumn(author, needed(author)).withColumn(text, needed(text))
    done = deidentify_messages(sound, names, salt, thread, text, strict)
    named = done.withColumn(author, ps.user(salt, F.col(author))).withColumn(channel, ps.label(salt, "channel", F.col(channel)))
    named = cut_lineage(named.withColumn(thread, ps.label(salt, "thread", F.col(thread).cast("string"))))
    by_author = F.struct(F.lit("author").alias("category"), F.col(author).alias("pseudonym"))
    opened = named.select(thread, F.explode(F.concat("deid_hits", F.array(by_author))).alias("h"))
    fine = opened.groupBy(thread, F.col("h.category").alias("category"), F.col("h.pseudonym").alias("pseudonym")).agg(F.count(F.lit(1)).alias("c"))
    report = fine.groupBy(thread, "category").agg(F.sum("c").alias("occurrences"), F.count("pseudonym").alias("distinct_pseudonyms"))
    kept = th.cap_threads(named.drop("deid_hits", "residue"), thread, turn, text, max_messages, max_chars)
    return kept, report, th.thread_counters(named, kept, thread)
