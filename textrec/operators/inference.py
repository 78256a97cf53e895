"""A text model applied to a table column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrec.functions.columns import ensure_columns
from textrec.operators.kept import keep_replies, kept_replies, prompt_digest
from textrec.session import stored

Messages = list[dict[str, str]]
Reply = tuple[str | None, Mapping[str, int] | None]

# Defaults of a completion.
SYSTEM = "You are a helpful AI assistant."
MAX_TOKENS = 100
TEMPERATURE = 1.0

# Prompts in one call.
BATCH_SIZE = 64

TOKENS = {"prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint"}
REPLY_COLUMNS = {"reply": "string", **TOKENS, "error": "string"}


@dataclass(frozen=True)
class Backend:
    """A model call supplied by the caller.

    ``call(conversations, system, max_tokens, temperature)`` returns one reply
    and its token usage per conversation. With ``inline_system`` the system
    prompt is the first message of each conversation and ``system`` is None.
    ``name`` tells models apart in the replies that a named run keeps.
    """

    call: Callable[[list[Messages], str | None, int, float], list[Reply]]
    inline_system: bool = False
    name: str = ""


def build_messages(turns: Column | str, system: str | None = None, inline: bool = False) -> Column:
    """Turns ``array<struct<user, assistant>>`` as ``array<struct<role, content>>``.

    A part that is null is left out. ``inline`` puts the system prompt first.
    """
    turns = F.col(turns) if isinstance(turns, str) else turns
    pairs = F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.lit("user").alias("role"), t["user"].alias("content")),
                F.struct(F.lit("assistant").alias("role"), t["assistant"].alias("content")),
            ),
        )
    )
    spoken = F.filter(pairs, lambda m: m["content"].isNotNull())
    if not inline:
        return spoken
    first = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
    return F.concat(F.array(first), spoken)


def _caller(backend: Backend, prompt_col: str, system: str, max_tokens: int, temperature: float, batch_size: int):
    """Function that adds reply, token counts and error to Arrow batches."""
    inline = [{"role": "system", "content": system}] if backend.inline_system else []
    apart = None if backend.inline_system else system

    def ask(prompts: list[str]) -> list[tuple[Reply, str | None]]:
        talks = [[*inline, {"role": "user", "content": p}] for p in prompts]
        try:
            replies = backend.call(talks, apart, max_tokens, temperature)
            if len(replies) != len(prompts):
                raise ValueError("one reply per prompt expected")
            return [(r, None) for r in replies]
        except Exception as error:
            if len(prompts) == 1:
                return [((None, None), f"{type(error).__name__}: {error}")]
            # One bad prompt fails its whole call: halves are asked until it is alone.
            half = len(prompts) // 2
            return ask(prompts[:half]) + ask(prompts[half:])

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        prompts = batch.column(batch.schema.get_field_index(prompt_col)).to_pylist()
        answers: list[tuple[Reply, str | None]] = [((None, None), None)] * len(prompts)
        asked = [i for i, prompt in enumerate(prompts) if prompt is not None]
        if asked:
            for i, given in zip(asked, ask([prompts[i] for i in asked])):
                answers[i] = given
        used = [usage or {} for (_, usage), _ in answers]
        added = {
            "_reply": pa.array([reply for (reply, _), _ in answers], pa.string()),
            **{f"_{t}": pa.array([u.get(t) for u in used], pa.int64()) for t in TOKENS},
            "_error": pa.array([error for _, error in answers], pa.string()),
        }
        return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The rows of a call at a time: a batch has thousands, whose prompts and replies need not be Python objects at once.
            valid = batch.column(batch.schema.get_field_index(prompt_col)).is_valid()
            calls = np.flatnonzero(valid.to_numpy(zero_copy_only=False))[batch_size::batch_size].tolist()
            bounds = [0, *calls, batch.num_rows]
            for start, end in zip(bounds, bounds[1:]):
                yield answer(batch.slice(start, end - start))

    return run


def answered(
    df: DataFrame,
    backend: Backend,
    prompt_col: str = "prompt",
    system: str = SYSTEM,
    max_tokens: int = MAX_TOKENS,
    temperature: float = TEMPERATURE,
    batch_size: int = BATCH_SIZE,
    partitions: int | None = None,
) -> DataFrame:
    """The rows with ``_reply``, three ``_…_tokens`` and ``_error``, null where the prompt is null.

    Other columns pass through Python as Arrow arrays and are not converted, so
    replies need no join to get back to their rows. Calls take longer than rows
    are large, so rows are spread by number over ``partitions`` parallel callers,
    by default as many as the cluster has cores. A call holds ``batch_size``
    prompts at most. Lazy: every use asks again.
    """
    df = df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
    added = T.StructType.fromDDL(", ".join(f"_{name} {kind}" for name, kind in REPLY_COLUMNS.items()))
    run = _caller(backend, prompt_col, system, max_tokens, temperature, batch_size)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def _with_digest(df: DataFrame, backend: Backend, prompt_col: str, options: Mapping) -> DataFrame:
    setting = {"system": SYSTEM, "max_tokens": MAX_TOKENS, "temperature": TEMPERATURE, **options}
    asked = [setting[name] for name in ("system", "max_tokens", "temperature")]
    return df.withColumn("_digest", prompt_digest(F.col(prompt_col), backend.name, backend.inline_system, *asked))


def _kept_answers(asked: DataFrame, backend: Backend, prompt_col: str, run: str, options: Mapping) -> DataFrame:
    """``asked``, which has a ``_digest``, with the ``_reply`` and so on that the run keeps, after asking for those it lacks."""
    spark = asked.sparkSession
    good = kept_replies(spark, run).where(F.col("error").isNull()).select(F.col("digest").alias("_digest"))
    wanted = asked.where(F.col("_digest").isNotNull()).select("_digest", prompt_col).dropDuplicates(["_digest"])
    new = answered(wanted.join(good, "_digest", "left_anti"), backend, prompt_col, **options)
    keep_replies(new.select(F.col("_digest").alias("digest"), *[F.col(f"_{c}").alias(c) for c in REPLY_COLUMNS]), run)
    had = kept_replies(spark, run).select(F.col("digest").alias("_digest"), *[F.col(c).alias(f"_{c}") for c in REPLY_COLUMNS])
    return asked.join(had, "_digest", "left").drop("_digest")


def ask_model(
    df: DataFrame, key: str, backend: Backend, prompt_col: str = "prompt", run: str | None = None, **options
) -> DataFrame:
    """``(key, reply, 3 token counts, error)`` for every prompt; keys must be unique.

    Replies are written once under their key, so a later failure does not call
    the model again. With the name of a ``run`` they are kept under a digest of
    the model's name, system prompt, settings and prompt. The same run then asks
    only for what it has no good reply to, whatever the keys; a prompt or setting
    that changed is asked for, and equal prompts are asked once.
    """
    kept = [F.col(f"_{c}").alias(c) for c in REPLY_COLUMNS]
    prompts = df.select(key, prompt_col)
    if run is None:
        return stored(answered(prompts, backend, prompt_col, **options).select(key, *kept), "replies")
    # Written first: prompts are read to find those that are new and again for their replies.
    asked = stored(_with_digest(prompts, backend, prompt_col, options), "prompts")
    return _kept_answers(asked, backend, prompt_col, run, options).select(key, *kept)


def _filled(df: DataFrame, columns: list[str], result_col: str, error_col: str | None) -> DataFrame:
    """Reply and token counts on rows with both a non-empty reply and usage; others keep theirs."""
    has_usage = F.coalesce(*[f"_{t}" for t in TOKENS]).isNotNull()
    done = F.coalesce((F.col("_reply") != "") & has_usage, F.lit(False))
    filled = {result_col: F.when(done, F.col("_reply")).otherwise(F.col(result_col))}
    filled |= {t: F.when(done, F.col(f"_{t}")).otherwise(F.col(t)) for t in TOKENS}
    if error_col is not None:
        filled[error_col] = F.col("_error")
    return df.withColumns(filled).select(*columns, *([error_col] if error_col else []))


def write_back(
    df: DataFrame, replies: DataFrame, key: str, result_col: str = "response", error_col: str | None = None
) -> DataFrame:
    """Replies of an earlier ``ask_model`` put on the rows with their key, which must be unique."""
    got = replies.select(key, *[F.col(c).alias(f"_{c}") for c in REPLY_COLUMNS])
    return _filled(df.join(got, key, "left"), df.columns, result_col, error_col)


def complete_prompts(
    df: DataFrame,
    backend: str,
    backends: Mapping[str, Backend],
    prompt_col: str = "prompt",
    result_col: str = "response",
    error_col: str | None = None,
    run: str | None = None,
    **options,
) -> DataFrame:
    """Reply and token counts for every row.

    A row with a null prompt, an empty reply or a failed call keeps its earlier
    result and null counts. An unknown backend name gives the table with the
    columns added and nothing filled in. ``options`` are those of ``answered``.
    The result is written once, so that no use of it calls the model again. With
    the name of a ``run`` replies are kept and asked for as in ``ask_model``.
    """
    ready = ensure_columns(df, keep={result_col: "string"}, reset=TOKENS)
    if backend not in backends:
        return ensure_columns(ready, {}, {error_col: "string"}) if error_col else ready
    chosen = backends[backend]
    if run is None:
        rows = answered(ready, chosen, prompt_col, **options)
    else:
        chosen = replace(chosen, name=chosen.name or backend)
        asked = stored(_with_digest(ready, chosen, prompt_col, options), "prompts")
        rows = _kept_answers(asked, chosen, prompt_col, run, options)
    return stored(_filled(rows, ready.columns, result_col, error_col), "completed")


def usage_totals(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows answered and tokens used, overall or per group."""
    sums = [F.sum(t).alias(t) for t in TOKENS]
    return df.groupBy(*(by or [])).agg(F.count("total_tokens").alias("answered"), *sums)
