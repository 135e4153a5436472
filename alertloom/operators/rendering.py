"""Model-visible text of a case and its three task calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom import fixed_values as fv

RENDER_VERSION = "state-render-2"


def in_key_order(value: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct inside it in alphabetical order, by the schema."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[in_key_order(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: in_key_order(x, kind.elementType))
    return value


def render_state(schema: T.StructType, include_signal: bool = True) -> Column:
    """Text from an allow-list of event and context fields of rows of `schema`; keys are in alphabetical order at every depth.

    The lines of the event's window follow its own. Labels, evidence and pair metadata are never read, so they cannot reach a
    candidate.
    """
    e = F.col("event")
    window = [e["window"]] if "window" in schema["event"].dataType.names else []
    iso = F.date_format(e["ts"], "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [e["host"].alias("host"), e["service"].alias("service")]
    if include_signal:
        fields.append(e["signal"].alias("signal"))
    fields.append(iso.alias("ts"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("EVENT format="), F.coalesce(e["format"], F.lit("unknown"))),
        e["raw"],
        *window,
        F.concat(F.lit("EVENT FIELDS "), F.to_json(F.struct(*fields))),
        F.concat(F.lit("CONTEXT "), F.to_json(in_key_order(F.col("context"), schema["context"].dataType))),
    )


def to_task_calls(cases: DataFrame, with_target: bool, include_signal: bool = True) -> DataFrame:
    """Three call rows per case. Targets exist only for training; an ungraded case cannot be one.

    `cases` holds case_id, cohort, pair_id, event, context and, with targets, the gold columns.
    """
    anchors = F.create_map(*[x for k, v in fv.PRIORITY_ANCHOR.items() for x in (F.lit(k), F.lit(str(v)))])
    golds = {
        "event_type": F.col("gold_event_type"),
        "page_now": F.col("gold_page_now").cast("string"),
        "priority": F.try_element_at(anchors, F.col("gold_priority")),
    } if with_target else {}
    options = F.array(*[F.lit(t) for t in fv.EVENT_TYPES])
    none = F.array().cast("array<string>")
    missing = F.raise_error(F.lit("an ungraded case cannot be a training target")).cast("string")
    items = [
        F.struct(
            F.lit(t).alias("task"),
            F.lit(fv.TASK_KIND[t]).alias("kind"),
            F.lit(fv.QUESTION_TEXT[t]).alias("question"),
            (options if t == "event_type" else none).alias("options"),
            (F.coalesce(golds[t], missing) if with_target else F.lit(None).cast("string")).alias("target"),
        )
        for t in fv.TASKS
    ]
    return (
        cases.withColumn("state", render_state(cases.schema, include_signal))
        .select("case_id", "pair_id", (F.col("cohort") == "B_prime").alias("adversarial"), "state", F.explode(F.array(*items)).alias("x"))
        .select("case_id", "pair_id", "adversarial", "state", "x.*")
    )


def mark_over_length(calls: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(calls within the cap, outcome rows `unsupported` for the rest). Nothing is truncated."""
    over = F.length("state") > cap
    rejected = calls.where(over).select("case_id", "task", F.lit("unsupported").alias("status"), F.concat(F.lit("input of "), F.length("state").cast("string"), F.lit(" characters exceeds the cap")).alias("error"))
    return calls.where(~over), rejected
