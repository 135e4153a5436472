"""Chat threads: contract, ordering, caps, assembly, claim scan, conversion to cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions.text import unicode
from alertloom.operators import rubric

CHUNK = 4096
#: Turns in one part of an assembled thread.
PART_TURNS = 64
#: What the context of a case is made of.
CONTEXT_PARTS = ("asset", "active_changes", "active_incidents")
OFFSET_TS = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def parse_ts(text: Column) -> Column:
    """ISO-8601 with a mandatory offset; NULL otherwise. The offset is required before parsing, because
    the parser would silently apply the session zone."""
    seconds = F.regexp_replace(text, r"^(.{16})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2")  # minutes alone do not parse
    return F.when(text.rlike(OFFSET_TS), F.try_to_timestamp(seconds))


def ts_violations(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", ts: str = "ts") -> DataFrame:
    """Messages earlier than the one before them, for threads of any length.

    A thread is cut into chunks of turns. Neighbours inside a chunk compare in a window over that
    chunk; neighbours across chunks compare on one row per chunk.
    """
    m = messages.select(thread, turn, ts).withColumn("_c", F.floor(F.col(turn) / CHUNK))
    inside = m.withColumn("prev", F.lag(ts).over(W.partitionBy(thread, "_c").orderBy(turn))).where(F.col(ts) < F.col("prev")).select(thread, turn)
    edges = m.groupBy(thread, "_c").agg(
        F.min_by(ts, turn).alias("first_ts"), F.min(turn).alias("first_turn"), F.max_by(ts, turn).alias("last_ts")
    )
    across = (
        edges.withColumn("prev", F.lag("last_ts").over(W.partitionBy(thread).orderBy("_c")))
        .where(F.col("first_ts") < F.col("prev"))
        .select(thread, F.col("first_turn").alias(turn))
    )
    return inside.union(across)


def message_contract(messages: DataFrame, roles: Sequence[str] = fv.ROLES) -> DataFrame:
    """Message rows (conv_id, turn, ts_text, role, author, text, channel_kind, ref_kind, ref_id) that break a rule."""
    c = F.col

    def rule(name: str, bad: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    checks = F.array_compact(
        F.array(
            rule("ts_needs_offset", parse_ts(c("ts_text")).isNull()),
            rule("unknown_role", ~c("role").isin(*roles)),
            rule("author_is_not_a_pseudonym", ~c("author").rlike(fv.AUTHOR_PSEUDONYM)),
            rule("empty_text", F.trim("text") == ""),
            rule("unknown_channel_kind", ~c("channel_kind").isin(*fv.CHANNEL_KINDS)),
            F.when(c("ref_kind").isNotNull() & ~c("ref_kind").isin(*fv.EVENT_REF_KINDS), "unknown_ref_kind"),
            F.when(c("ref_id").isNotNull() & ~c("ref_id").rlike(fv.EVENT_REF_ID), "bad_ref_id"),
        )
    )
    return messages.select("conv_id", "turn", F.explode(checks).alias("rule"))


def cap_threads(
    messages: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text",
    max_messages: int = fv.MAX_MESSAGES_PER_THREAD, max_chars: int = fv.MAX_MESSAGE_CHARS,
) -> DataFrame:
    """Keep the last `max_messages` of a thread, then cut each text to `max_chars`. Run after de-identification.

    The rank filter is pruned to `max_messages` rows per thread in every input partition before the
    shuffle, so a thread holding a third of the rows sends only its tail.
    """
    last = F.row_number().over(W.partitionBy(thread).orderBy(F.col(turn).desc()))
    kept = messages.withColumn("_r", last).where(F.col("_r") <= max_messages).drop("_r")
    return kept.withColumn("was_cut", F.length(text) > max_chars).withColumn(text, F.substring(text, 1, max_chars))


def thread_counters(messages: DataFrame, capped: DataFrame, thread: str = "conv_id") -> DataFrame:
    """Per thread: original, kept, dropped and cut counts."""
    before = messages.groupBy(thread).agg(F.count(F.lit(1)).alias("original_message_count"))
    after = capped.groupBy(thread).agg(F.count(F.lit(1)).alias("messages_kept"), F.count_if(F.col("was_cut")).alias("messages_cut"))
    return before.join(after, thread).withColumn("messages_dropped", F.col("original_message_count") - F.col("messages_kept"))


def assemble(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", part_turns: int = PART_TURNS) -> DataFrame:
    """(thread, part, messages): ordered message arrays, one per `part_turns` turns of a thread.

    No message is dropped or cut, and no array grows with the length of a thread.
    """
    msg = F.struct(F.col(turn).alias("turn"), "ts", "role", "author", "text")
    part = F.floor(F.col(turn) / part_turns).cast("int").alias("part")
    return messages.groupBy(thread, part).agg(F.sort_array(F.collect_list(msg)).alias("messages"))


def claim_names(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(unicode("(?i)" + p)), F.lit(n)) for n, p in fv.CLAIM_PATTERNS]))


def claims(messages: DataFrame, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Unverified authorization wording: (thread, turn, role, pattern, verified). Never the text."""
    return messages.select(
        thread, turn, "role", F.explode(claim_names(F.col("text"))).alias("pattern"), F.lit(False).alias("verified")
    )


def to_cases(threads: DataFrame, refs: DataFrame, structured_ids: DataFrame, thread: str = "conv_id", question: str = "page_now", about: DataFrame | None = None) -> DataFrame:
    """Assembled parts of threads to cases. The event shows roles only; claims and the reference check stay in `meta`.

    `refs` is (thread, ref_kind, ref_id); `structured_ids` is one column `id` of known changes and incidents. `about` adds per
    thread what it has of `channel_kind`, `dataset_kind`, the counters `truncated_messages` and `truncated_chars_messages`, and
    `context`; a context must hold asset, active_changes and active_incidents, and nothing else of it is kept.
    """
    known = structured_ids.select(F.col("id").alias("ref_id")).distinct().withColumn("ref_found", F.lit(True))
    j = threads.join(refs, thread, "left").join(known, "ref_id", "left")
    have: set[str] = set()
    if about is not None:
        have = set(about.columns) - {thread}
        if "context" in have:
            absent = [k for k in CONTEXT_PARTS if k not in about.schema["context"].dataType.names]
            if absent:
                raise ValueError(f"the context lacks {absent}")
        j = j.join(about, thread, "left")
    shown = F.transform("messages", lambda m: F.struct(m["ts"].alias("t"), m["role"].alias("role"), m["text"].alias("text")))
    found = F.flatten(
        F.transform(
            "messages",
            lambda m, i: F.transform(
                claim_names(m["text"]),
                lambda name: F.struct(i.alias("message_index"), m["role"].alias("role"), name.alias("pattern"), F.lit(False).alias("verified")),
            ),
        )
    )
    context = [F.struct(*[F.col(f"context.{k}").alias(k) for k in CONTEXT_PARTS]).alias("context")] if "context" in have else []
    return j.select(
        thread,
        "part",
        F.struct(F.lit("chat_thread").alias("format"), *[c for c in ("channel_kind",) if c in have], F.get("messages", F.lit(0))["ts"].alias("ts"), shown.alias("messages")).alias("event"),
        *context,
        F.lit(question).alias("question"),
        F.struct(
            F.lit("chat").alias("source"), F.lit("untrusted_user_text").alias("trust"), *[c for c in ("dataset_kind", "truncated_messages", "truncated_chars_messages") if c in have],
            found.alias("unverified_claims"), "ref_kind", "ref_id", F.coalesce("ref_found", F.lit(False)).alias("event_ref_found"), F.lit(False).alias("show_to_model"),
        ).alias("meta"),
    )


def label_threads(
    messages: DataFrame, evidence: DataFrame, changes: DataFrame | rubric.Index, incidents: DataFrame | rubric.Index, thread: str = "conv_id", turn: str = "turn",
    ts: str = "ts", entity_columns: Sequence[str] = ("host", "service"),
) -> DataFrame:
    """The rubric's label of every thread that has evidence, at the time of its first message.

    `evidence` holds per thread the host, signal and evidence its case author supplies. Only the times of messages are read:
    no text can change a label.
    """
    first = messages.groupBy(thread).agg(F.min_by(ts, turn).alias("ts"))
    return rubric.label_tables(evidence.join(first, thread), changes, incidents, entity_columns)
