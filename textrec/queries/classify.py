"""Rule classifiers over the documents, and the tables behind the plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.functions.columns import strip
from textrec.functions.keywords import contains_any, decision_tree, first_match, keyword_hits, refine
from textrec.operators.classify import EntryRules, Override, classify_entries, override
from textrec.operators.rules import first_match_table
from textrec.operators.tables import distinct_sorted
from textrec.plans.explorer import consequence_plot, function_plot
from textrec.queries.inputs import any_sql, read, strip_sql
from textrec.queries.registry import query

KIND_RULES = [
    (["tionre", "quela"], "Scout"),
    (["ungen", "mente", "thered", "ciónes", "eauxle"], "Courier"),
    (["andth", "osde", "heitei", "ereon", "tioner", "aldis", "oiqu"], "Archive"),
]
KIND_DEFAULT = "Clerk"

VALUE_RULES = [(["ouère", "berich", "shth"], 40), (["nden"], 10)]
VALUE_DEFAULT = 25

OVERRIDE = Override(
    label="Courier",
    words=["ertion", "ichsch", "arla"],
    lift_words=["shing", "lere"],
    lift_to=30,
    force_words=["thethe", "lesles"],
    force_to=90,
)


def proximity(has, name, sector, agent):
    """One early branch; the rest starts low and is refined twice, the second time in steps."""
    last = refine(30, (F.endswith(agent, F.lit("7")), 31), (F.contains(name, F.lit("src1")), 33))
    return decision_tree([(has(["ntat"]) & F.startswith(agent, F.lit("src1")), 50)], refine(10, (sector < "es", 11), (has(["zu", "quel"]), last)))


RULES = EntryRules(KIND_RULES, KIND_DEFAULT, VALUE_RULES, VALUE_DEFAULT, proximity, OVERRIDE)


def case_sql(rules, default) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {any_sql('low', words)} THEN {value(v)}" for words, v in rules)
    return f"CASE {whens} ELSE {value(default)} END"


ENTRIES_SQL = f"""entries AS (
    SELECT doc_id, trim(replace('* ' || source || ' org*', '*', '')) AS name, lang AS sector, source AS agent_type,
        {strip_sql('text')} AS description, lower({strip_sql('text')}) AS low FROM documents)"""

TREE_SQL = f"""CASE WHEN contains(low, 'ntat') AND starts_with(lower(agent_type), 'src1') THEN 50
    WHEN {any_sql('low', ['zu', 'quel'])} THEN
        CASE WHEN contains(lower(name), 'src1') THEN 33 WHEN ends_with(lower(agent_type), '7') THEN 31 ELSE 30 END
    WHEN lower(sector) < 'es' THEN 11 ELSE 10 END"""

SCORED_SQL = f"""{ENTRIES_SQL},
scored AS (
    SELECT *, {case_sql(KIND_RULES, KIND_DEFAULT)} AS kind, {case_sql(VALUE_RULES, VALUE_DEFAULT)} AS worth,
        {TREE_SQL} AS near FROM entries),
turned AS (
    SELECT *, kind <> '{OVERRIDE.label}' AND {any_sql('low', OVERRIDE.words)} AS turn FROM scored),
classified AS (
    SELECT doc_id, name AS Organization, sector AS Sector, agent_type AS Agent_Type_Text,
        CASE WHEN regexp_extract(description, '([^.!?]+[.!?])', 1) <> ''
             THEN regexp_extract(description, '([^.!?]+[.!?])', 1)
             WHEN length(description) > 150 THEN left(description, 150) || '...' ELSE description END AS Description,
        CASE WHEN turn THEN '{OVERRIDE.label}' ELSE kind END AS Kind_of_Agent,
        worth AS Economic_Value,
        CASE WHEN {any_sql('low', OVERRIDE.force_words)} THEN {OVERRIDE.force_to}
             WHEN turn AND near < {OVERRIDE.lift_to} AND {any_sql('low', OVERRIDE.lift_words)} THEN {OVERRIDE.lift_to} ELSE near END AS Proximity_NCF,
        description AS Full_Description_Tooltip
    FROM turned)"""

KINDS = ["Archive", "Clerk", "Courier", "Scout"]
AGENT_TYPES = ["src0", "src1", "src2", "src3", "src4", "src5"]
COLOURS = {"Archive": "grey", "Clerk": "teal", "Courier": "orange", "Scout": "black"}
COLOUR_SQL = f"CASE Kind_of_Agent {' '.join(f"WHEN '{kind}' THEN '{colour}'" for kind, colour in COLOURS.items())} END"


def entries(spark, folder):
    return read(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("* "), "source", F.lit(" org*")).alias("name"),
        F.col("lang").alias("sector"),
        F.col("source").alias("agent_type"),
        F.col("text").alias("description"),
    )


def classified(spark, folder, one_pass=False):
    return classify_entries(entries(spark, folder), RULES, keep=["doc_id"], one_pass=one_pass)


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, {case_sql(KIND_RULES, KIND_DEFAULT)} AS label FROM entries")
def first_match_label(spark, folder):
    low = entries(spark, folder).select("doc_id", F.lower("description").alias("low"))
    return low.select("doc_id", first_match("low", KIND_RULES, KIND_DEFAULT).alias("label"))


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, {case_sql(VALUE_RULES, VALUE_DEFAULT)} AS score FROM entries")
def first_match_score(spark, folder):
    low = entries(spark, folder).select("doc_id", F.lower("description").alias("low"))
    return low.select("doc_id", first_match("low", VALUE_RULES, VALUE_DEFAULT).alias("score"))


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, {TREE_SQL} AS near FROM entries")
def decision_tree_score(spark, folder):
    low = entries(spark, folder).select("doc_id", *[F.lower(c).alias(c) for c in ["description", "name", "sector", "agent_type"]])
    has = lambda words: contains_any("description", words)
    return low.select("doc_id", proximity(has, *[F.col(c) for c in ["name", "sector", "agent_type"]]).alias("near"))


@query(f"""WITH {ENTRIES_SQL}
SELECT doc_id, CASE WHEN contains(low, 'shing') THEN CASE WHEN length(low) > 900 THEN 3 ELSE 2 END
    WHEN contains(low, 'que') THEN 1 ELSE 0 END AS score FROM entries""")
def refined_score(spark, folder):
    """A base value, refined by one step and then by another that has steps of its own."""
    low = entries(spark, folder).select("doc_id", F.lower(strip("description")).alias("low"))
    steps = [(contains_any("low", ["que"]), 1), (contains_any("low", ["shing"]), refine(2, (F.length("low") > 900, 3)))]
    return low.select("doc_id", refine(0, *steps).alias("score"))


@query(f"""WITH {ENTRIES_SQL},
s AS (SELECT doc_id, low, {case_sql(KIND_RULES, KIND_DEFAULT)} AS label, {case_sql(VALUE_RULES, VALUE_DEFAULT)} AS score FROM entries),
t AS (SELECT *, label <> '{OVERRIDE.label}' AND {any_sql('low', OVERRIDE.words)} AS turn FROM s)
SELECT doc_id, CASE WHEN turn THEN '{OVERRIDE.label}' ELSE label END AS label,
    CASE WHEN {any_sql('low', OVERRIDE.force_words)} THEN {OVERRIDE.force_to}
         WHEN turn AND score < {OVERRIDE.lift_to} AND {any_sql('low', OVERRIDE.lift_words)} THEN {OVERRIDE.lift_to} ELSE score END AS score FROM t""")
def override_rules(spark, folder):
    low = entries(spark, folder).select("doc_id", F.lower("description").alias("low"))
    labelled = low.select(
        "doc_id",
        "low",
        first_match("low", KIND_RULES, KIND_DEFAULT).alias("label"),
        first_match("low", VALUE_RULES, VALUE_DEFAULT).alias("score"),
    )
    has = lambda words: contains_any("low", words)
    return labelled.withColumns(override(OVERRIDE, "label", "score", has)).drop("low")


@query(f"""WITH {ENTRIES_SQL}
SELECT doc_id, {any_sql('low', KIND_RULES[0][0])} AS first, {any_sql('low', KIND_RULES[2][0])} AS second,
    {any_sql('low', ['the', 'data'])} AS third FROM entries""")
def keywords_in_one_pass(spark, folder):
    groups = [KIND_RULES[0][0], KIND_RULES[2][0], ["The", "DATA"]]
    hits = entries(spark, folder).select("doc_id", keyword_hits(F.lower("description"), groups).alias("h"))
    return hits.select("doc_id", *[F.get("h", F.lit(i)).alias(n) for i, n in enumerate(["first", "second", "third"])])


@query(f"WITH {SCORED_SQL} SELECT * FROM classified")
def classified_entries(spark, folder):
    return classified(spark, folder)


@query(f"WITH {SCORED_SQL} SELECT * FROM classified")
def classified_entries_in_one_pass(spark, folder):
    return classified(spark, folder, one_pass=True)


RULE_TABLE_SQL = """WITH words AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS keyword FROM benchmark),
rules AS (
    SELECT -length(keyword) AS priority, keyword, CASE WHEN min(item_id) % 7 > 0 THEN 'item ' || min(item_id) END AS value
    FROM words WHERE keyword <> '' GROUP BY keyword),
ranked AS (SELECT *, row_number() OVER (ORDER BY priority, keyword) AS place FROM rules),
hits AS (SELECT d.doc_id, min(r.place) AS place FROM documents d JOIN ranked r ON contains(lower(d.text), r.keyword) GROUP BY d.doc_id)
SELECT d.doc_id, CASE WHEN h.doc_id IS NULL THEN 'none' ELSE r.value END AS label
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN ranked r ON r.place = h.place"""


def word_rules(spark, folder):
    """Rules that come as a table: all words of the benchmark's texts, the longest first, some without a value."""
    words = read(spark, folder, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("keyword"))
    items = words.where("keyword <> ''").groupBy("keyword").agg(F.min("item_id").alias("item"))
    value = F.when(F.col("item") % 7 > 0, F.concat(F.lit("item "), F.col("item").cast("string")))
    return items.select((-F.length("keyword")).alias("priority"), "keyword", value.alias("value"))


@query(RULE_TABLE_SQL)
def rules_as_table(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return first_match_table(docs, word_rules(spark, folder), "text", "label", "none").drop("text")


@query(RULE_TABLE_SQL)
def rules_as_long_table(spark, folder):
    """The same in many indexes, one after the other."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return first_match_table(docs, word_rules(spark, folder), "text", "label", "none", rules_per_index=200).drop("text")


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_sorted_values(spark, folder):
    return distinct_sorted(read(spark, folder, "documents"), "source")


def plot_sql(y: str, label: str, where: str) -> str:
    return f"""WITH {SCORED_SQL}
SELECT doc_id, Agent_Type_Text AS x, {y} AS y, '{label}' AS y_label, {COLOUR_SQL} AS colour,
    CAST(nullif(list_position({AGENT_TYPES}, Agent_Type_Text), 0) AS INTEGER) AS x_rank,
    CAST(nullif(list_position({KINDS}, Kind_of_Agent), 0) AS INTEGER) AS kind_rank,
    Organization, Sector, Agent_Type_Text, Kind_of_Agent, Description, Full_Description_Tooltip
FROM classified WHERE {where}"""


@query(plot_sql("Sector", "Sector", "true"))
def function_plot_all(spark, folder):
    return function_plot(classified(spark, folder), "All Sectors", KINDS, AGENT_TYPES, COLOURS, "doc_id")


@query(plot_sql("Kind_of_Agent", "Kind of Agent", "Sector = 'fr'"))
def function_plot_sector(spark, folder):
    return function_plot(classified(spark, folder), "fr", KINDS, AGENT_TYPES, COLOURS, "doc_id")


@query(plot_sql("Sector", "Sector", "true"))
def function_plot_unknown_sector(spark, folder):
    return function_plot(classified(spark, folder), "zz", KINDS, AGENT_TYPES, COLOURS, "doc_id")


@query(f"""WITH {SCORED_SQL}
SELECT doc_id, Economic_Value AS x, Proximity_NCF AS y, Economic_Value AS size, {COLOUR_SQL} AS colour,
    Organization, Sector, Agent_Type_Text, Kind_of_Agent, Description, Full_Description_Tooltip FROM classified""")
def consequence_plot_all(spark, folder):
    return consequence_plot(classified(spark, folder), COLOURS, "doc_id")
