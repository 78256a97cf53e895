"""Findings in the documents, their themes, and the reports on them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textrec.functions.replies import reply_clusters, reply_findings, reply_items
from textrec.operators.filters import docs_with_all, tag_matches
from textrec.operators.findings import report_totals, sections, with_titles
from textrec.operators.texts import explode_findings
from textrec.plans.reports import ORDER, json_report, markdown_report
from textrec.plans.screening import analyse_batches, screen_documents
from textrec.plans.themes import cluster_findings, indexed_findings
from textrec.queries.inputs import document_names, pages, read
from textrec.queries.registry import query
from textrec.queries.screening import BATCHES_SQL, TERMS, WORDS, relevant
from textrec.queries.standins import BACKENDS
from textrec.session import shared_folder
from textrec.sources.sinks import write_lines

DATE = "2025-01-31T00:00:00"

FINDINGS_SQL = f"""{BATCHES_SQL},
findings AS (
    SELECT batch, CAST((row_number() OVER (PARTITION BY batch ORDER BY source, page, para)) - 1 AS INTEGER) AS pos,
        CAST(length(text) % 5 AS INTEGER) AS question_num, text AS quote, source, page, md5(text) AS summary
    FROM batched)"""

PLACED_SQL = f"""{FINDINGS_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY question_num ORDER BY batch, pos) - 1 AS idx FROM findings)"""

CLUSTERS_SQL = f"""{PLACED_SQL},
themed AS (
    SELECT question_num, page % 3 AS number, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx,
        CAST(sum(idx) AS BIGINT) AS idx_sum, arg_min(quote, idx) AS key_quote FROM placed GROUP BY ALL),
clusters AS (
    SELECT question_num, row_number() OVER (PARTITION BY question_num ORDER BY number) - 1 AS item, number,
        'theme ' || number AS theme, n || ' findings' AS summary, n, first_idx, last_idx, idx_sum, key_quote FROM themed)"""

TOTALS_SQL = """totals AS (
    SELECT (SELECT count(*) FROM documents) AS total_documents,
        (SELECT count(*) FROM flags WHERE matched) AS relevant_documents,
        (SELECT count(*) FROM findings) AS total_findings)"""


def questions(spark, folder):
    regions = read(spark, folder, "region")
    return regions.select(
        F.col("r_regionkey").alias("question_num"), F.col("r_name").alias("question"), F.lower("r_name").alias("title")
    )


def findings(spark, folder):
    return analyse_batches(relevant(spark, folder), questions(spark, folder), BACKENDS["find"]).drop("raw")


def screening(spark, folder):
    return screen_documents(
        document_names(spark, folder),
        pages(spark, folder),
        TERMS,
        WORDS,
        questions(spark, folder),
        BACKENDS["find"],
        BACKENDS["cluster"],
        sep="\n",
    )


def dated(run):
    return run.totals.withColumn("analysis_date", F.lit(DATE))


@query("""SELECT doc_id, 0 AS pos, CAST(n_chars % 7 AS INTEGER) AS question_num, text AS quote, source,
    CAST(length(text) % 9 AS INTEGER) AS page, lang AS summary FROM documents
UNION ALL SELECT doc_id, 1, CAST(n_chars % 5 AS INTEGER), lang, source, 1, 'short' FROM documents""")
def findings_read_from_replies(spark, folder):
    """Replies with JSON inside prose, made from the documents and read back."""
    first = F.struct(
        (F.col("n_chars") % 7).cast("int").alias("question_num"),
        F.col("text").alias("quote"),
        "source",
        (F.length("text") % 9).alias("page"),
        F.col("lang").alias("summary"),
    )
    second = F.struct(
        (F.col("n_chars") % 5).cast("int").alias("question_num"),
        F.col("lang").alias("quote"),
        "source",
        F.lit(1).alias("page"),
        F.lit("short").alias("summary"),
    )
    reply = F.concat(F.lit("Found this: "), F.to_json(F.struct(F.array(first, second).alias("findings"))), F.lit(" Done."))
    replies = read(spark, folder, "documents").select(F.col("doc_id").alias("batch"), reply.alias("reply"))
    found = replies.select("batch", reply_findings("reply").alias("findings"))
    return explode_findings(found).withColumnRenamed("batch", "doc_id").drop("raw")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS n,
    CASE WHEN doc_id % 5 IN (2, 3) THEN CAST(n_chars AS INTEGER) END AS page,
    CASE WHEN doc_id % 5 > 1 THEN lang END AS extra FROM documents""")
def uneven_replies(spark, folder):
    """Replies without JSON, with no findings, and with numbers as text, with decimals and as words, and a key of their own."""
    page = F.expr("""CASE doc_id % 5 WHEN 2 THEN concat('"', n_chars, '"') WHEN 3 THEN concat(n_chars, '.0') ELSE '"many"' END""")
    one = F.concat(F.lit('So: {"findings": [{"page": '), page, F.lit(', "extra": "'), F.col("lang"), F.lit('"}]} there.'))
    kind = F.col("doc_id") % 5
    reply = F.when(kind == 0, "nothing here").when(kind == 1, '{"findings": []}').otherwise(one)
    found = read(spark, folder, "documents").select("doc_id", reply_findings(reply).alias("found"))
    first = F.get("found", F.lit(0))
    return found.select(
        "doc_id",
        F.when(F.col("found").isNotNull(), F.size("found")).alias("n"),
        first["f"]["page"].alias("page"),
        F.get_json_object(first["raw"], "$.extra").alias("extra"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'theme' END AS theme, CASE WHEN doc_id % 3 > 0 THEN n_chars::INTEGER END AS last
FROM documents WHERE doc_id % 3 <> 2""")
def uneven_themes(spark, folder):
    """Replies with a theme, with none and without JSON; only the last are left out."""
    kind = F.col("doc_id") % 3
    themed = F.concat(F.lit('{"clusters": [{"theme": "theme", "finding_indices": [0, "x", "'), F.col("n_chars").cast("string"), F.lit('"]}]}'))
    reply = F.when(kind == 0, "{}").when(kind == 1, themed).otherwise("{broken")
    docs = read(spark, folder, "documents").select("doc_id", reply_clusters(reply).alias("clusters"))
    first = F.get("clusters", F.lit(0))
    return docs.where(F.col("clusters").isNotNull()).select(
        "doc_id", first["theme"].alias("theme"), F.get(first["finding_indices"], F.lit(1)).alias("last")
    )


@query("SELECT doc_id, 0 AS n FROM documents")
def replies_without_json(spark, folder):
    """The documents themselves hold no JSON: nothing is found."""
    docs = read(spark, folder, "documents")
    return docs.select("doc_id", F.size(F.coalesce(reply_items("text", "findings"), F.array().cast("array<string>"))).alias("n"))


@query("""SELECT e.event_id, CAST(json_extract(e.props, '$.k') AS INTEGER) % 7 AS question_num,
    coalesce(r.r_name, 'Unknown') AS title
FROM events e LEFT JOIN region r ON r.r_regionkey = CAST(json_extract(e.props, '$.k') AS INTEGER) % 7""")
def question_titles(spark, folder):
    number = (F.get_json_object("props", "$.k").cast("int") % 7).alias("question_num")
    events = read(spark, folder, "events").select("event_id", number)
    titles = read(spark, folder, "region").select(F.col("r_regionkey").alias("question_num"), F.col("r_name").alias("title"))
    return with_titles(events, titles)


@query(f"WITH {FINDINGS_SQL} SELECT * FROM findings")
def analysed_batches(spark, folder):
    return findings(spark, folder)


@query(f"WITH {PLACED_SQL} SELECT question_num, idx, batch, pos, md5(quote || '|' || source || '|' || page) AS digest FROM placed")
def findings_per_question(spark, folder):
    """Every finding at its place among those of its question."""
    found = analyse_batches(relevant(spark, folder), questions(spark, folder), BACKENDS["find"])
    line = F.concat_ws("|", "quote", "source", F.col("page").cast("string"))
    return indexed_findings(found).select("question_num", "idx", "batch", "pos", F.md5(line).alias("digest"))


@query(f"WITH {FINDINGS_SQL}, {TOTALS_SQL} SELECT * FROM totals")
def totals_of_report(spark, folder):
    docs = tag_matches(document_names(spark, folder), docs_with_all(pages(spark, folder), TERMS))
    return report_totals(docs, findings(spark, folder))


@query(f"WITH {CLUSTERS_SQL} SELECT * EXCLUDE (number) FROM clusters")
def theme_clusters(spark, folder):
    """The themes of each question, found by rounds, with what their findings' places come to."""
    found = screening(spark, folder).themes
    sums = [F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum("idx").alias("idx_sum")]
    places = found.members.groupBy("question_num", "item").agg(*sums)
    each = found.themes.select("question_num", "item", "theme", "summary", F.get("key_quotes", F.lit(0)).alias("key_quote"))
    return each.join(places, ["question_num", "item"])


@query(f"""WITH {CLUSTERS_SQL}
SELECT question_num, c.item, p.idx, c.theme FROM placed p JOIN clusters c USING (question_num) WHERE c.number = p.page % 3""")
def theme_members(spark, folder):
    """Every finding with its theme, over three rounds or more where a prompt lists 20 entries."""
    found = analyse_batches(relevant(spark, folder), questions(spark, folder), BACKENDS["find"])
    themes = cluster_findings(indexed_findings(found), BACKENDS["cluster"], per_prompt=20)
    named = themes.themes.select("question_num", "item", "theme")
    return themes.members.join(named, ["question_num", "item"]).select("question_num", "item", "idx", "theme")


@query(f"WITH {FINDINGS_SQL} SELECT question_num, count(*) AS n FROM findings GROUP BY question_num ORDER BY question_num")
def report_sections(spark, folder):
    counts = findings(spark, folder).groupBy("question_num").agg(F.count("*").alias("n"))
    return sections(counts)


MARKDOWN_SQL = f"""WITH {CLUSTERS_SQL}, {TOTALS_SQL},
lines AS (
    SELECT 0 AS section, -1 AS question_num, 0 AS block, -1 AS item, -1 AS step,
        unnest(range(11))::INTEGER AS line_no, unnest(['# Risks', 'Generated: {DATE}', 'Total Documents: ' || total_documents,
        'Documents Analyzed (all terms): ' || relevant_documents, 'Total Relevant Findings: ' || total_findings,
        '', '## Executive Summary', '', 'First line.', 'Second line.', '']) AS line FROM totals
    UNION ALL
    SELECT 1, question_num, 0, -1, -1, unnest(range(3))::INTEGER,
        unnest(['', '## Question ' || question_num || ': ' || lower(r_name), ''])
    FROM (SELECT DISTINCT question_num FROM clusters) JOIN region ON r_regionkey = question_num
    UNION ALL
    SELECT 1, question_num, 1, item, -1, unnest(range(5))::INTEGER,
        unnest(['### ' || theme, '', summary, '', '**Key Quotes:**']) FROM clusters
    UNION ALL SELECT 1, question_num, 1, item, 0, 0, '- "' || key_quote || '"' FROM clusters
    UNION ALL SELECT 1, question_num, 1, item, 2147483647, 0, '' FROM clusters)
SELECT * FROM lines"""


@query(MARKDOWN_SQL)
def markdown_lines(spark, folder):
    run = screening(spark, folder)
    titles = questions(spark, folder)
    return markdown_report(dated(run), run.themes, titles, "Risks", "all terms", "First line.\nSecond line.")


@query(MARKDOWN_SQL.replace("SELECT * FROM lines", "SELECT line FROM lines"))
def written_report(spark, folder):
    """The Markdown report written as text and read back."""
    path = f"{shared_folder(spark)}/textrec/report-{uuid.uuid4().hex}"
    write_lines(markdown_lines(spark, folder), ORDER, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"""WITH {CLUSTERS_SQL}, {TOTALS_SQL},
quoted AS (SELECT question_num, md5(string_agg(quote, chr(10) ORDER BY idx)) AS quotes, count(*) AS raw_findings
    FROM placed GROUP BY question_num),
themes AS (SELECT question_num, string_agg(theme, ',' ORDER BY item) AS themes, CAST(sum(idx_sum) AS BIGINT) AS idx_sum
    FROM clusters GROUP BY question_num)
SELECT total_documents, relevant_documents, total_findings, question_num, themes, idx_sum, raw_findings, quotes
FROM totals, quoted JOIN themes USING (question_num)""")
def json_report_contents(spark, folder):
    """The report's lines read as one document; its contents by question."""
    run = screening(spark, folder)
    return report_contents(json_report(dated(run), run.themes, run.findings, "all terms"))


def report_contents(lines):
    """Lines of a report, by what they hold, with commas between them taken off."""
    body = F.when(F.startswith("line", F.lit(",")), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    lines = lines.withColumn("body", body)
    head = lambda name: F.max(F.when(F.startswith("line", F.lit(f'"{name}": ')), F.regexp_extract("line", r": (\d+),", 1)))
    counts = ["total_documents", "relevant_documents", "total_findings"]
    top = lines.where("section = 0").agg(*[head(c).cast("bigint").alias(c) for c in counts])
    ordered = lambda name: F.array_sort(F.collect_list(F.struct("item", F.get_json_object("body", f"$.{name}").alias("v"))))
    joined = lambda name, sep: F.array_join(F.transform(ordered(name), lambda r: r["v"]), sep)
    theme = lines.where("block = 1 AND step = -1").withColumn("body", F.concat("body", F.lit("]}")))
    themes = theme.groupBy("question_num").agg(joined("theme", ",").alias("themes"))
    places = lines.where("block = 1 AND step BETWEEN 0 AND 2147483646").groupBy("question_num")
    themes = themes.join(places.agg(F.sum(F.col("body").cast("bigint")).alias("idx_sum")), "question_num")
    raw = lines.where("section = 1 AND block = 3").groupBy("question_num")
    raw = raw.agg(F.count("*").alias("raw_findings"), F.md5(joined("quote", "\n")).alias("quotes"))
    both = themes.join(raw, "question_num")
    return both.withColumns({c: top.select(c).scalar() for c in counts})
