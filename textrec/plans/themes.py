"""Themes of findings by rounds of bounded prompts, one set for each question."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.functions.replies import reply_clusters
from textrec.operators.batching import number_rows
from textrec.operators.inference import Backend, ask_model
from textrec.operators.texts import render_prompt
from textrec.session import stored

# Findings, or themes of an earlier round, in one prompt.
ITEMS_PER_PROMPT = 100

# Reply length.
CLUSTER_TOKENS = 2000

# The caller may pass templates of its own with the same names in braces.
CLUSTER_TEMPLATE = (
    "Sort these findings on question {question} into themes and summarise each theme:\n{findings}\n\n"
    'Reply with JSON only: {{"clusters": [{{"theme": "", "summary": "", "finding_indices": [0], '
    '"key_quotes": [""]}}]}}'
)
MERGE_TEMPLATE = (
    "These themes were found in parts of the findings on question {question}. Join those that belong together, "
    "so that few are left, and summarise each:\n{findings}\n\n"
    'Reply with JSON only, with the places of the joined themes as indices: {{"clusters": [{{"theme": "", '
    '"summary": "", "finding_indices": [0], "key_quotes": [""]}}]}}'
)

THEME = "question_num int, item bigint, theme string, summary string, key_quotes array<string>, n_findings bigint"
MEMBER = "question_num int, item bigint, idx bigint"


@dataclass(frozen=True)
class Themes:
    """Long tables, so that a theme may have any number of findings.

    ``questions (question_num)``: those with an answer, be it without themes.
    ``themes (question_num, item, theme, summary, key_quotes, n_findings)``.
    ``members (question_num, item, idx)``: the findings of each theme, ``idx`` counted from the question's first.
    ``errors (question_num, round, part, error)``: failed calls.
    """

    questions: DataFrame
    themes: DataFrame
    members: DataFrame
    errors: DataFrame


def indexed_findings(findings: DataFrame) -> DataFrame:
    """``findings`` with ``idx``, their place from 0 among those of their question, by batch and position.

    A null question number is a question of its own. Written once.
    """
    numbered = number_rows(findings, ["batch", "pos"], by=["question_num"], name="_no")
    return numbered.withColumn("idx", F.col("_no") - 1).drop("_no")


def _key(question: str = "question_num") -> Column:
    """A question's number as a join key, also for a null one."""
    return F.coalesce(F.col(question).cast("string"), F.lit("none"))


def _number(key: str = "q") -> Column:
    return F.col(key).try_cast("int")


def _listed(items: DataFrame, per_prompt: int) -> DataFrame:
    """``(q, part, size, listed)``: consecutive items of a question as a JSON list, ``per_prompt`` at most."""
    part = F.expr(f"idx div {int(per_prompt)}").alias("part")
    entries = F.array_sort(F.collect_list(F.struct("idx", "entry")))
    grouped = items.select("q", part, "idx", "entry").groupBy("q", "part").agg(entries.alias("entries"))
    texts = F.array_join(F.transform("entries", lambda e: e["entry"]), ", ")
    return grouped.select("q", "part", F.size("entries").alias("size"), F.concat(F.lit("["), texts, F.lit("]")).alias("listed"))


def _asked(parts: DataFrame, backend: Backend, template: str, options: Mapping) -> DataFrame:
    """``(q, part, size, clusters, error)``: the themes of each part; null where the reply holds no JSON."""
    keyed = parts.withColumn("place", F.struct("q", "part", "size"))
    prompts = render_prompt(keyed, template, question=_number(), findings=F.col("listed"))
    replies = ask_model(prompts, "place", backend, **{"max_tokens": CLUSTER_TOKENS, "temperature": 0.0, **options})
    return replies.select("place.*", reply_clusters("reply").alias("clusters"), "error")


def cluster_findings(
    indexed: DataFrame,
    backend: Backend,
    per_prompt: int = ITEMS_PER_PROMPT,
    template: str = CLUSTER_TEMPLATE,
    merge_template: str = MERGE_TEMPLATE,
    **options,
) -> Themes:
    """One set of themes for each question, whatever the number of its findings.

    ``indexed`` is ``indexed_findings(findings)``. A prompt lists ``per_prompt``
    findings at most, as their replies gave them. Where a question has more, the
    themes of its parts are listed in turn, each with its number of findings, and
    the model joins them, until a question's themes come from one prompt. Indices
    in replies count the listed entries from 0; they are followed back to the
    findings by joins, so neither a prompt nor a row grows with a question. An
    index that names no entry is left out, and a finding that no theme names is
    in none. Every round has at most one ``per_prompt``-th of the prompts of the
    one before if replies have one theme, and ends for questions whose themes
    became no fewer: they keep those they have.

    A part whose reply holds no JSON adds no themes and is listed in ``errors``
    if the call failed; a question of which no part has an answer, or whose last
    prompt has none, is left out. Templates have ``{question}`` and
    ``{findings}``; ``options`` are those of ``ask_model``.
    """
    spark = indexed.sparkSession
    items = indexed.select(_key().alias("q"), "idx", F.col("raw").alias("entry"))
    links: DataFrame | None = None
    done: dict[str, list[DataFrame]] = {"questions": [], "themes": [], "members": [], "errors": []}
    turn = 0
    while True:
        replies = _asked(_listed(items, per_prompt), backend, template if turn == 0 else merge_template, options)
        done["errors"].append(replies.where(F.col("error").isNotNull()).select(_number().alias("question_num"), F.lit(turn).alias("round"), "part", "error"))
        # Themes are numbered over a question's parts; only the parts' numbers of themes meet by question.
        sizes = replies.select("q", "part", "size", F.coalesce(F.size("clusters"), F.lit(0)).alias("n"), F.col("clusters").isNotNull().alias("read"))
        before = Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("q", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        each = replies.join(offsets, ["q", "part"]).select("q", "part", "size", "offset", F.posexplode("clusters").alias("at", "c"))
        found = each.withColumn("item", F.col("offset") + F.col("at"))
        places = found.select("q", "item", "part", "size", F.explode("c.finding_indices").alias("i"))
        named = places.where("i >= 0 AND i < size").select("q", "item", (F.col("part") * per_prompt + F.col("i")).alias("below"))
        if links is None:
            links = named.select("q", "item", F.col("below").alias("idx")).distinct()
        else:
            links = links.withColumnRenamed("item", "below").join(named, ["q", "below"]).select("q", "item", "idx").distinct()
        links = stored(links, "members")
        counts = links.groupBy("q", "item").agg(F.count("*").alias("n_findings"))
        themes = found.select("q", "item", "c.theme", "c.summary", "c.key_quotes").join(counts, ["q", "item"], "left")
        themes = stored(themes.fillna(0, ["n_findings"]), "themes")
        # How a question goes on: with one part it is done, and also when there are no fewer themes than entries.
        whole = sizes.groupBy("q").agg(F.count("*").alias("parts"), F.sum("size").alias("entries"), F.count_if("read").alias("read"), F.sum("n").alias("n"))
        state = whole.where("read > 0").withColumn("last", F.expr("parts = 1 OR n = 0 OR n >= entries"))
        ready = state.where("last").select("q")
        done["questions"].append(ready.select(_number().alias("question_num")))
        done["themes"].append(themes.join(ready, "q", "left_semi").select(_number().alias("question_num"), "item", "theme", "summary", "key_quotes", "n_findings"))
        done["members"].append(links.join(ready, "q", "left_semi").select(_number().alias("question_num"), "item", "idx"))
        going = state.where("NOT last").select("q")
        if going.isEmpty():
            break
        entry = F.struct("theme", "summary", F.col("n_findings").alias("findings"), "key_quotes")
        items = themes.join(going, "q", "left_semi").select("q", F.col("item").alias("idx"), F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))
        links = links.join(going, "q", "left_semi")
        turn += 1
    return Themes(**{name: reduce(DataFrame.union, tables) for name, tables in done.items()})


def nested_clusters(themes: Themes) -> DataFrame:
    """``(question_num, clusters)``: the themes of a question in one row, each with all its ``finding_indices``.

    For callers who want them so: a row holds as many numbers as a question has findings.
    """
    at = [_key().alias("q"), "item"]
    listed = themes.members.groupBy(*at).agg(F.sort_array(F.collect_list(F.col("idx").cast("int"))).alias("finding_indices"))
    each = themes.themes.select(*at, "theme", "summary", "key_quotes").join(listed, ["q", "item"], "left")
    none = F.array().cast("array<int>")
    cluster = F.struct("theme", "summary", F.coalesce("finding_indices", none).alias("finding_indices"), "key_quotes")
    rows = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("item", cluster.alias("c")))).alias("rows"))
    clusters = F.transform(F.coalesce("rows", F.array()), lambda r: r["c"])
    return themes.questions.select(_key().alias("q")).join(rows, "q", "left").select(_number().alias("question_num"), clusters.alias("clusters"))
