"""Scoring calls with a user function, and turning raw results into typed outcomes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom import fixed_values as fv
from alertloom.functions.stats import level_from_score

RAW_SCHEMA = (
    "candidate string, case_id {case_type}, task string, options array<string>, status string, choice string, "
    "choice_probs map<string,double>, score double, prob double, probability_source string, error string"
)


class Unsupported(RuntimeError):
    """Raised by a scoring function that cannot do this task."""


class SchemaFailure(ValueError):
    """Raised by a scoring function whose backend broke the contract."""


def typed_value(task: str, choice: str, prob: str, score: str) -> Column:
    """The typed answer of one call, as text: event type, page decision or P level."""
    t = F.col(task)
    return (
        F.when(t == "event_type", F.col(choice))
        .when(t == "page_now", (F.col(prob) >= fv.PAGE_THRESHOLD).cast("string"))
        .otherwise(level_from_score(F.col(score)))
    )


def result_error(tolerance: float = 0.02) -> Column:
    """Why a raw result breaks the contract, or NULL. Pure column code over choice, choice_probs, score, prob."""
    values = F.map_values("choice_probs")
    bad_value = F.exists(values, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    total = F.aggregate(values, F.lit(0.0), lambda acc, p: acc + p)
    keys_differ = (F.size(F.array_except("options", F.map_keys("choice_probs"))) > 0) | (
        F.size(F.array_except(F.map_keys("choice_probs"), "options")) > 0
    )
    choice = (
        F.when(F.col("choice").isNull() | ~F.array_contains("options", F.col("choice")), "choice is outside allowed options")
        .when(F.col("choice_probs").isNull(), None)
        .when(keys_differ, "choice probability keys differ from options")
        .when(bad_value, "choice probability outside [0,1]")
        .when(F.abs(total - 1) > tolerance, "choice probabilities do not sum to one")
    )
    score = F.when(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 100), "score must be finite and within [0,100]")
    prob = F.when(F.col("prob").isNull() | F.isnan("prob") | ~F.col("prob").between(0, 1), "probability must be finite and within [0,1]")
    return F.when(F.col("task") == "event_type", choice).when(F.col("task") == "priority", score).otherwise(prob)


def to_outcomes(raw: DataFrame) -> DataFrame:
    """Raw results to outcome facts; a result that breaks the contract becomes `schema_failure`."""
    broken = result_error()
    status = F.when((F.col("status") == "ok") & broken.isNotNull(), "schema_failure").otherwise(F.col("status"))
    df = raw.withColumn("broken", F.when(F.col("status") == "ok", broken)).withColumn("status", status)
    ok = F.col("status") == "ok"
    return df.select(
        "candidate",
        "case_id",
        "task",
        "status",
        F.when(ok & (F.col("task") == "event_type"), F.col("choice")).alias("value_type"),
        F.when(ok & (F.col("task") == "page_now"), F.col("prob") >= fv.PAGE_THRESHOLD).alias("value_page"),
        F.when(ok & (F.col("task") == "priority"), level_from_score(F.col("score"))).alias("value_priority"),
        F.when(ok & (F.col("task") == "page_now"), F.col("prob")).alias("probability"),
        F.when(ok & (F.col("task") == "page_now"), F.col("probability_source")).alias("probability_source"),
        F.when(ok & (F.col("task") == "priority"), F.col("score")).alias("raw_score"),
        F.substring(F.coalesce("error", "broken"), 1, fv.ERROR_TEXT_CAP).alias("error"),
    )


def batch_score(
    calls: DataFrame,
    candidate: str,
    score_fn: Callable[[dict], dict],
    supported: Sequence[str] = fv.TASKS,
) -> DataFrame:
    """Run `score_fn` over task calls and return outcome facts.

    Calls of an undeclared task never reach Python: the filter sits before `mapInPandas`, which
    Catalyst cannot move it through. The target column is dropped first, so a candidate cannot read
    the answer. `score_fn` gets one call as a dict and returns choice / choice_probs / score / prob.
    """
    case_type = calls.schema["case_id"].dataType.simpleString()
    schema = RAW_SCHEMA.format(case_type=case_type)
    visible = [c for c in ("case_id", "task", "kind", "question", "options", "state", "adversarial") if c in calls.columns]
    blind = calls.select(*visible)
    cap = fv.ERROR_TEXT_CAP

    def one(call: dict) -> dict:
        out = {"status": "ok", "choice": None, "choice_probs": None, "score": None, "prob": None, "probability_source": "model", "error": None}
        try:
            out.update(score_fn(call))
        except Unsupported as exc:
            out.update(status="unsupported", error=str(exc)[:cap])
        except SchemaFailure as exc:
            out.update(status="schema_failure", error=str(exc)[:cap])
        except Exception as exc:  # a backend failure is recorded, never turned into a prediction
            out.update(status="exception", error=f"{type(exc).__name__}: {str(exc)[:cap]}")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(r) for r in batch.to_dict("records")]
            out = pd.DataFrame(rows)
            out.insert(0, "task", batch["task"].to_numpy())
            out.insert(0, "case_id", batch["case_id"].to_numpy())
            out.insert(0, "candidate", candidate)
            out["options"] = [list(o) if o is not None else [] for o in batch["options"]]
            yield out[["candidate", "case_id", "task", "options", "status", "choice", "choice_probs", "score", "prob", "probability_source", "error"]]

    return _with_undeclared(blind, candidate, supported, lambda calls: calls.mapInPandas(run, schema))


def _with_undeclared(blind: DataFrame, candidate: str, supported: Sequence[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    declared = F.col("task").isin(*supported)
    skipped = blind.where(~declared).select(
        F.lit(candidate).alias("candidate"),
        "case_id",
        "task",
        F.lit("unsupported").alias("status"),
        F.lit("task not among the candidate's declared tasks").alias("error"),
    )
    return to_outcomes(score(blind.where(declared))).unionByName(skipped, allowMissingColumns=True)


#: Scorers of this worker process, by candidate and the digest of the function that made them.
_LOADED: dict[tuple[str, str], Callable] = {}


def loaded(candidate: str, maker: bytes) -> Callable:
    """The candidate's scorer, made once in this worker; a worker keeps one scorer at a time."""
    key = (candidate, hashlib.sha256(maker).hexdigest())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = cloudpickle.loads(maker)()
    return _LOADED[key]


def batch_score_arrow(
    calls: DataFrame,
    candidate: str,
    make_scorer: Callable[[], Callable[[pa.RecordBatch], Sequence[dict]]],
    supported: Sequence[str] = fv.TASKS,
    rows: int = 1024,
) -> DataFrame:
    """`batch_score` for scorers that take many calls at once.

    `make_scorer` runs once per worker process, not per task, so a model is loaded once. What it returns scores a record batch of
    at most `rows` calls: one dict per call, choice / choice_probs / score / prob, or `status` and `error`. If a batch raises
    or gives another number of results, its halves are scored apart, down to the call that fails, which keeps its own error.
    """
    maker = cloudpickle.dumps(make_scorer)
    case_type = calls.schema["case_id"].dataType.simpleString()
    visible = [c for c in ("case_id", "task", "kind", "question", "options", "state", "adversarial") if c in calls.columns]
    cap = fv.ERROR_TEXT_CAP
    empty = {"status": "ok", "choice": None, "choice_probs": None, "score": None, "prob": None, "probability_source": "model", "error": None}

    def failed(exc: Exception) -> dict:
        status = "unsupported" if isinstance(exc, Unsupported) else "schema_failure" if isinstance(exc, SchemaFailure) else "exception"
        return {"status": status, "error": str(exc)[:cap] if status != "exception" else f"{type(exc).__name__}: {str(exc)[:cap]}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(candidate, maker)

        def score(part: pa.RecordBatch) -> list[dict]:
            try:
                found = list(scorer(part))
                if len(found) != len(part):
                    raise SchemaFailure(f"{len(found)} results for {len(part)} calls")
                return [dict(r) for r in found]
            except Exception as exc:  # a backend failure is recorded, never turned into a prediction
                if len(part) == 1:
                    return [failed(exc)]
                half = len(part) // 2
                return score(part.slice(0, half)) + score(part.slice(half))

        number = pa.float64()
        kinds = {"status": pa.string(), "choice": pa.string(), "choice_probs": pa.map_(pa.string(), number), "score": number, "prob": number, "probability_source": pa.string(), "error": pa.string()}
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                found = [empty | r for r in score(part)]
                columns = {name: pa.array([list(r[name].items()) if isinstance(r[name], dict) else r[name] for r in found], kind) for name, kind in kinds.items()}
                head = {"candidate": pa.array([candidate] * len(part)), "case_id": part.column("case_id"), "task": part.column("task"), "options": part.column("options")}
                yield pa.RecordBatch.from_arrays([*head.values(), *columns.values()], names=[*head, *columns])

    return _with_undeclared(calls.select(*visible), candidate, supported, lambda declared: declared.mapInArrow(run, RAW_SCHEMA.format(case_type=case_type)))
