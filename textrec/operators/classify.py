"""Rule classifiers for short descriptions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.functions.columns import clean_name, lead_sentence, strip
from textrec.functions.keywords import KeywordTests, Rule, Test, first_match, refine


@dataclass(frozen=True)
class Override:
    """Late corrections of a label and a score.

    ``words`` turn any other label into ``label``; where they do, a score below
    ``lift_to`` rises to it if a ``lift_words`` occurs. ``force_words`` then set
    the score to ``force_to`` for every row.
    """

    label: str
    words: Sequence[str]
    lift_words: Sequence[str]
    lift_to: int
    force_words: Sequence[str]
    force_to: int


@dataclass(frozen=True)
class EntryRules:
    """All rules of one classifier.

    ``proximity`` builds the score tree from a function that tests the
    description for keywords and the lower-cased name, sector and agent type.
    """

    kind: Sequence[Rule]
    kind_default: str
    value: Sequence[Rule]
    value_default: int
    proximity: Callable[[Test, Column, Column, Column], Column]
    override: Override | None = field(default=None)


def override(rule: Override, label: str, score: str, has: Test) -> dict[str, Column]:
    """The corrected label and score; every condition reads both from before the correction.

    ``has`` tests the description for keywords.
    """
    turned = (F.col(label) != rule.label) & has(rule.words)
    lifted = turned & (F.col(score) < rule.lift_to) & has(rule.lift_words)
    forced = has(rule.force_words)
    return {
        label: F.when(turned, rule.label).otherwise(F.col(label)),
        score: refine(F.col(score), (lifted, rule.lift_to), (forced, rule.force_to)),
    }


def classify_entries(
    df: DataFrame,
    rules: EntryRules,
    keep: Sequence[str] = (),
    name: str = "name",
    description: str = "description",
    sector: str = "sector",
    agent_type: str = "agent_type",
    one_pass: bool = False,
) -> DataFrame:
    """Eight output columns per entry, after the ``keep`` columns. Narrow: no shuffle.

    Each text is cleaned and lower-cased once, in its own projection; Catalyst
    keeps it apart from the rules that read it many times. With ``one_pass`` all
    tests of a description are made by ``keyword_hits``, which pays for many keywords.
    """
    has = KeywordTests("_low", "_hits", at_once=one_pass)
    scores = {
        "Description": lead_sentence("Full_Description_Tooltip"),
        "Kind_of_Agent": first_match(has, rules.kind, rules.kind_default),
        "Economic_Value": first_match(has, rules.value, rules.value_default),
        "Proximity_NCF": rules.proximity(has, F.col("_name"), F.col("_sector"), F.col("_agent")),
    }
    cleaned = df.select(
        *keep,
        clean_name(name).alias("Organization"),
        F.col(sector).alias("Sector"),
        F.col(agent_type).alias("Agent_Type_Text"),
        strip(description).alias("Full_Description_Tooltip"),
    )
    lowered = cleaned.select(
        "*",
        F.lower("Full_Description_Tooltip").alias("_low"),
        F.lower("Organization").alias("_name"),
        F.lower("Sector").alias("_sector"),
        F.lower("Agent_Type_Text").alias("_agent"),
    )
    corrections = override(rules.override, "Kind_of_Agent", "Proximity_NCF", has) if rules.override else {}
    # After all tests are made: only now is it known what to look for.
    tested = lowered.withColumn("_hits", has.column()) if has.at_once else lowered
    scored = tested.withColumns(scores)
    scored = scored.withColumns(corrections) if corrections else scored
    return scored.select(
        *keep,
        "Organization",
        "Sector",
        "Agent_Type_Text",
        "Description",
        "Kind_of_Agent",
        "Economic_Value",
        "Proximity_NCF",
        "Full_Description_Tooltip",
    )
