"""Queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents
from ..sources import corpus
from .registry import big, query, r6


@query(r"""WITH b AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'text' WHEN 2 THEN 'table' ELSE 'image' END AS label FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))
  SELECT id, string_agg(CASE label WHEN 'table' THEN 'c' || chr(10) || l_partkey ELSE 't' || l_partkey END, chr(10) ORDER BY pos) AS text,
  string_agg(CASE label WHEN 'doc_title' THEN '# t' || l_partkey WHEN 'table' THEN '<table><tr><td>c</td><td>' || l_partkey || '</td></tr></table>' ELSE 't' || l_partkey END, chr(10) || chr(10) ORDER BY pos) AS markdown,
  count(*) FILTER (WHERE label = 'table') AS tables FROM b WHERE label <> 'image' GROUP BY id""")
def q83_blocks_to_pages(t, spark):
    li = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    k, s = F.col("p") % 4, F.col("p").cast("string")
    label = F.when(k == 0, "doc_title").when(k == 1, "text").when(k == 2, "table").otherwise("image")
    content = F.when(k == 2, F.concat(F.lit("<table><tr><td>c</td><td>"), s, F.lit("</td></tr></table>"))).otherwise(F.concat(F.lit("t"), s))
    pages = documents.blocks_to_pages(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), label.alias("label"), content.alias("content")))
    return pages.select("id", "text", "markdown", big(F.size("tables")).alias("tables"))


@query()
def q84_document_scores(t, spark):
    """Every document with its language, whole, written as Markdown with a table and parsed again, against itself."""
    table = F.concat(F.lit("<table><tr><td>"), "lang", F.lit("</td><td>"), F.col("doc_id").cast("string"), F.lit("</td></tr></table>"))
    d = t("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("# "), "text", F.lit("\n"), table).alias("markdown"), F.concat("text", F.lit("\n"), "lang", F.lit("\n"), F.col("doc_id").cast("string")).alias("ref_text"), F.array(table, table).alias("ref_tables"))
    return documents.document_scores(d).select("id", r6("cer").alias("cer"), r6("teds").alias("teds"), big("n_tables").alias("n_tables"))


@query("""WITH w AS (SELECT o_orderpriority AS category, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'w' || o_custkey END AS ref, o_orderkey % 5 <> 0 AS same, o_orderkey % 2 = 0 AS num FROM orders)
  SELECT category, CASE WHEN GROUPING(num) = 1 THEN NULL WHEN num THEN 'number' ELSE 'other' END AS kind, count(*) AS n, round(avg(same::INT), 6) AS accuracy, round(avg(CASE WHEN same THEN 0.0 ELSE least(1.0, 1.0 / length(ref)) END), 6) AS cer, CAST(0 AS BIGINT) AS overflow
  FROM w GROUP BY GROUPING SETS ((category), (category, num))""")
def q85_word_accuracy(t, spark):
    k = F.col("o_orderkey")
    ref = F.when(k % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("w"), F.col("o_custkey").cast("string")))
    w = t("orders").select(F.col("o_orderpriority").alias("category"), ref.alias("ref"), F.when(k % 5 != 0, ref).otherwise(F.concat(F.lit("x"), F.substr(ref, F.lit(2)))).alias("hyp"))
    a = documents.word_accuracy(w)
    return a.select("category", "kind", "n", r6("accuracy").alias("accuracy"), r6("cer").alias("cer"), big("overflow").alias("overflow"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE trim(c_mktsegment || ' ') END AS text FROM customer""")
def q86_correction_fallback(t, spark):
    out = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit(" ")))
    return t("customer").select(F.col("c_custkey").alias("id"), documents.with_fallback(out, F.col("c_name")).alias("text"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'recognised' ELSE 'native' END AS source, CAST(CASE WHEN page_id % 3 = 0 THEN length(url) ELSE length(html) END AS BIGINT) AS n FROM pages""")
def q87_page_text(t, spark):
    p = corpus.page_text(F.when(F.col("page_id") % 3 != 0, F.col("html")).otherwise(" short "), F.col("url"))
    return t("pages").select("page_id", p.alias("p")).select("page_id", "p.source", big(F.length("p.text")).alias("n"))
