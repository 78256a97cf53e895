"""Filters, page texts, paragraphs and context blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.operators.batching import assign_batches, number_rows
from textrec.operators.filters import (
    by_role,
    docs_with_all,
    docs_with_any,
    excerpt,
    filter_or_all,
    non_blank,
    require,
    tag_matches,
)
from textrec.operators.tables import first_n, table_counts
from textrec.operators.texts import (
    full_text,
    keep_passing,
    paragraphs,
    relevant_paragraphs,
    render_prompt,
    text_segments,
)
from textrec.plans.screening import context_table
from textrec.queries.inputs import (
    MESSAGES_SQL,
    PAGES_SQL,
    PARAS_SQL,
    SAMPLES_SQL,
    any_sql,
    document_names,
    messages,
    pages,
    read,
    samples,
    strip_sql,
)
from textrec.queries.registry import query
from textrec.session import stored

TERMS = ["tion", "The"]
WORDS = ["data", "orantion", "ingen", "eauxi", "ladel", "schen"]

FLAGS_SQL = f"""flags AS (
    SELECT doc, bool_or(contains(lower(text), 'tion')) AND bool_or(contains(lower(text), 'the')) AS matched
    FROM doc_pages GROUP BY doc)"""

RELEVANT_SQL = f"""{PARAS_SQL}, {FLAGS_SQL},
relevant AS (
    SELECT p.* FROM paras p JOIN flags f ON f.doc = p.source WHERE f.matched AND {any_sql('lower(p.text)', WORDS)})"""

BATCHES_SQL = f"""{RELEVANT_SQL},
batched AS (
    SELECT *, (row_number() OVER (ORDER BY source, page, para) - 1) // 10 AS batch FROM relevant),
contexts AS (
    SELECT batch, count(*) AS paragraphs,
        string_agg('[Source: ' || source || ', Page ' || page || ']' || chr(10) || text, chr(10) || chr(10)
            ORDER BY source, page, para) AS context
    FROM batched GROUP BY batch)"""


def relevant(spark, folder):
    paged = pages(spark, folder)
    return relevant_paragraphs(paged, docs_with_all(paged, TERMS), WORDS, sep="\n")


@query(f"WITH {MESSAGES_SQL} SELECT * FROM messages WHERE role = 'assistant'")
def filter_by_role(spark, folder):
    return by_role(messages(spark, folder), "assistant")


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, target FROM samples WHERE target IS NOT NULL")
def require_column(spark, folder):
    return require(samples(spark, folder), "target").select("sample_id", "target")


@query("""SELECT 'samples' AS "table", count(*) AS rows FROM documents UNION ALL SELECT 'with_grade', 0""")
def require_absent_column(spark, folder):
    """All samples, and those left when a column is required that they lack."""
    every = samples(spark, folder)
    return table_counts({"samples": every, "with_grade": require(every, "grade")})


@query(f"""WITH {PAGES_SQL}
SELECT doc, bool_or({any_sql('lower(text)', WORDS)}) AS matched FROM doc_pages GROUP BY doc""")
def any_keyword_documents(spark, folder):
    return docs_with_any(pages(spark, folder), WORDS)


@query(f"WITH {PAGES_SQL}, {FLAGS_SQL} SELECT doc, matched FROM flags")
def all_keyword_documents(spark, folder):
    return docs_with_all(pages(spark, folder), TERMS)


@query(f"""WITH {PAGES_SQL}, whole AS (
    SELECT doc, lower(string_agg(text, chr(10) ORDER BY page) || chr(10)) AS t FROM doc_pages GROUP BY doc)
SELECT doc, contains(t, '.' || chr(10)) AND contains(t, 'the') AS matched FROM whole""")
def all_keyword_line_breaks(spark, folder):
    return docs_with_all(pages(spark, folder), [".\n", "the"])


@query(f"""WITH m AS (SELECT source, bool_or(contains(lower(text), 'orantion')) AS matched FROM documents GROUP BY source)
SELECT source AS doc, matched FROM m""")
def any_keyword_sources(spark, folder):
    docs = read(spark, folder, "documents").select(F.col("source").alias("doc"), "text")
    return docs_with_any(docs, ["orantion"])


@query(f"SELECT doc_id, lang FROM documents WHERE length({strip_sql('text')}) > 0")
def non_blank_documents(spark, folder):
    return non_blank(read(spark, folder, "documents"), "text").select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr'")
def filter_or_all_hit(spark, folder):
    return filter_or_all(read(spark, folder, "documents").select("doc_id", "lang", "source"), "lang", "fr")


@query("SELECT doc_id, lang, source FROM documents")
def filter_or_all_miss(spark, folder):
    return filter_or_all(read(spark, folder, "documents").select("doc_id", "lang", "source"), "lang", "none such")


@query(f"""WITH {PAGES_SQL}, {FLAGS_SQL}
SELECT n.doc, coalesce(f.matched, false) AS matched
FROM (SELECT 'doc_' || doc_id || '.pdf' AS doc FROM documents UNION ALL SELECT 'page_' || page_id FROM pages) n
LEFT JOIN flags f ON f.doc = n.doc""")
def tagged_documents(spark, folder):
    unread = read(spark, folder, "pages").select(F.format_string("page_%d", "page_id").alias("doc"))
    names = document_names(spark, folder).unionByName(unread)
    return tag_matches(names, docs_with_all(pages(spark, folder), TERMS))


@query(f"""WITH {PAGES_SQL}
SELECT doc, length(t) AS n, md5(t) AS digest
FROM (SELECT doc, string_agg(text, chr(10) ORDER BY page) || chr(10) AS t FROM doc_pages GROUP BY doc)""")
def full_texts(spark, folder):
    whole = full_text(pages(spark, folder))
    return whole.select("doc", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query(f"""WITH {PAGES_SQL}
SELECT doc, length(t) AS n, md5(t) AS digest
FROM (SELECT doc, left(string_agg(text, chr(10) ORDER BY page) || chr(10), 5000) AS t FROM doc_pages GROUP BY doc)""")
def full_texts_capped(spark, folder):
    whole = full_text(pages(spark, folder), cap=5000)
    return whole.select("doc", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query(f"""WITH {PAGES_SQL},
whole AS (SELECT doc, string_agg(text, chr(10) ORDER BY page) || chr(10) AS t FROM doc_pages GROUP BY doc),
cut AS (SELECT doc, t, unnest(range((length(t) + 699) // 700)) AS segment FROM whole)
SELECT doc, segment, segment * 700 AS start, substr(t, segment * 700 + 1, 700) AS text FROM cut""")
def segmented_texts(spark, folder):
    """Whole texts in segments, whose ends seldom are those of pages."""
    return text_segments(pages(spark, folder), 700)


@query(f"WITH {PARAS_SQL} SELECT source, page, para, text FROM paras")
def page_paragraphs(spark, folder):
    return paragraphs(pages(spark, folder), sep="\n")


@query(f"""WITH {PARAS_SQL}, {FLAGS_SQL}
SELECT p.source, p.page, p.para, p.text FROM paras p JOIN flags f ON f.doc = p.source WHERE f.matched""")
def passing_paragraphs(spark, folder):
    paged = pages(spark, folder)
    return keep_passing(paragraphs(paged, sep="\n"), docs_with_all(paged, TERMS))


@query(f"WITH {RELEVANT_SQL} SELECT source, page, para, text FROM relevant")
def relevant_paragraph_rows(spark, folder):
    return relevant(spark, folder)


@query(f"WITH {BATCHES_SQL} SELECT batch, paragraphs, context FROM contexts")
def context_block_rows(spark, folder):
    return context_table(relevant(spark, folder))


@query(f"""WITH {BATCHES_SQL}
SELECT batch, 'Batch ' || batch || ' of {{two}}:' || chr(10) || context || chr(10) || 'End.' AS prompt FROM contexts""")
def rendered_prompts(spark, folder):
    contexts = context_table(relevant(spark, folder))
    prompts = render_prompt(
        contexts, "Batch {b} of {{two}}:\n{context}\nEnd.", b=F.col("batch"), context=F.col("context")
    )
    return prompts.select("batch", "prompt")


@query(f"""WITH {PARAS_SQL}
SELECT source, page, para, (row_number() OVER (ORDER BY source, page, para) - 1) // 10 AS batch FROM paras""")
def fixed_size_batches(spark, folder):
    paras = paragraphs(pages(spark, folder), sep="\n").select("source", "page", "para")
    # Written first: sorting reads its input twice.
    return assign_batches(stored(paras, "paragraphs"), ["source", "page", "para"], 10)


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row_no
    FROM lineitem""")
def numbered_rows(spark, folder):
    items = read(spark, folder, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return number_rows(items, ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@query("""SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no
    FROM events""")
def numbered_rows_in_groups(spark, folder):
    events = read(spark, folder, "events").select("event_type", "ts", "event_id")
    return number_rows(events, ["ts", "event_id"], by=["event_type"]).drop("ts")


@query("SELECT doc_id, 0::BIGINT AS batch FROM documents")
def one_batch(spark, folder):
    return assign_batches(read(spark, folder, "documents").select("doc_id"), ["doc_id"])


@query(f"""WITH {SAMPLES_SQL}
SELECT sample_id, target, score FROM samples WHERE target IS NOT NULL AND score IS NOT NULL ORDER BY sample_id LIMIT 3""")
def first_valid_rows(spark, folder):
    valid = F.col("target").isNotNull() & F.col("score").isNotNull()
    return first_n(samples(spark, folder), valid, 3, ["sample_id"]).select("sample_id", "target", "score")


@query("""SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50""")
def display_excerpt(spark, folder):
    docs = read(spark, folder, "documents")
    return excerpt(docs, ["doc_id", "lang", "source", "n_chars"], 50, [F.desc("n_chars"), "doc_id"])


@query("""SELECT 'doc_' || doc_id || '.pdf' AS doc FROM documents ORDER BY doc LIMIT 5""")
def first_files(spark, folder):
    return excerpt(document_names(spark, folder), ["doc"], 5, ["doc"])
