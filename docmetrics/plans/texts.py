"""Queries over texts: normalisation, repair, extraction, chunks, documents' statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext, metrics, text
from ..operators import answers, extraction, retrieval, routing, sampling, scoring, tables
from ..shared import scratch
from ..sources import corpus, results
from .registry import big, query, r6


@query("""SELECT lang AS category, count(*) AS n, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars,
  CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang""")
def q01_manifest_stats(t, spark):
    truth = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "source", F.lit(None).cast("string").alias("parent"), "text", F.split("text", "\n").alias("lines"), F.lit(0).alias("width"), F.lit(0).alias("height"))
    return corpus.build_manifest(truth).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("lines").alias("lines"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS normalized,
  CAST(length(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS BIGINT) AS n FROM documents""")
def q02_text_normalize(t, spark):
    n = text.normalize(F.col("text"))
    return t("documents").select("doc_id", n.alias("x")).select("doc_id", F.md5("x").alias("normalized"), big(F.length("x")).alias("n"))


@query(r"""SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS BIGINT) AS squashed,
  CAST(length(regexp_replace(text, '\s+', '', 'g')) AS BIGINT) AS no_space,
  CAST(length(regexp_replace(text, '[\s,원]', '', 'g')) AS BIGINT) AS no_amount FROM documents""")
def q03_squash_lengths(t, spark):
    c = F.col("text")
    return t("documents").select("doc_id", big(F.length(text.squash_symbols(c))).alias("squashed"), big(F.length(text.squash_spaces(c))).alias("no_space"), big(F.length(text.squash_amount(c))).alias("no_amount"))


@query("""SELECT doc_id, md5(translate(text, '–—−‐×，．：‘’“”', '----x,.:''''""')) AS fixed FROM documents""")
def q14_rules_symbols(t, spark):
    return t("documents").select("doc_id", F.md5(text.fix_symbols(F.col("text"))).alias("fixed"))


_DIGITS = "x"
for _letters, _digit in text.DIGIT_LIKE:
    for _ in range(2):
        _DIGITS = f"regexp_replace({_DIGITS}, '([0-9,.])[{_letters}]([0-9,.])', '\\1{_digit}\\2', 'g')"


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, translate(CAST(l_partkey * 10007 + l_suppkey AS VARCHAR), '0158', 'OlSB') || '.' || CAST(l_orderkey AS VARCHAR) AS x FROM lineitem)
  SELECT l_orderkey, l_linenumber, {_DIGITS} AS fixed FROM d""")
def q15_rules_digits(t, spark):
    number = F.translate((F.col("l_partkey") * 10007 + F.col("l_suppkey")).cast("string"), "0158", "OlSB")
    return t("lineitem").select("l_orderkey", "l_linenumber", text.fix_digits(F.concat(number, F.lit("."), F.col("l_orderkey").cast("string"))).alias("fixed"))


@query(r"""WITH c AS (SELECT c_custkey, '0' || CAST(c_custkey % 90 + 10 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE ' ' END || CAST(c_custkey % 9000 + 1000 AS VARCHAR) || ' ' || CAST(c_nationkey * 37 % 9000 + 1000 AS VARCHAR) AS x FROM customer)
  SELECT c_custkey, regexp_replace(x, '(0[0-9]{1,2})[ .]([0-9]{3,4})[ .]([0-9]{4})', '\1-\2-\3', 'g') AS phone FROM c""")
def q16_rules_phone(t, spark):
    k = F.col("c_custkey")
    x = F.concat(F.lit("0"), (k % 90 + 10).cast("string"), F.when(k % 2 == 0, ".").otherwise(" "), (k % 9000 + 1000).cast("string"), F.lit(" "), (F.col("c_nationkey") * 37 % 9000 + 1000).cast("string"))
    return t("customer").select("c_custkey", text.fix_phone(x).alias("phone"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' / ' || strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders WHERE year(o_orderdate) >= 2000
  UNION ALL SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '. ' || CAST(month(o_orderdate) AS VARCHAR) || '. ' || CAST(day(o_orderdate) AS VARCHAR) || '. / ' || strftime(o_orderdate, '%Y.%m.%d') AS iso FROM orders WHERE year(o_orderdate) < 2000""")
def q17_dates_iso(t, spark):
    d = F.col("o_orderdate")
    loose = F.concat(F.year(d).cast("string"), F.lit(". "), F.month(d).cast("string"), F.lit(". "), F.dayofmonth(d).cast("string"), F.lit(". / "), F.date_format(d, "yyyy.MM.dd"))
    return t("orders").select("o_orderkey", text.iso_dates(loose).alias("iso"))


_BIZ = " + ".join(f"CAST(substr(x, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(text.BIZ_WEIGHTS))


@query(f"""WITH c AS (SELECT c_custkey AS key, lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS x FROM customer
    UNION ALL SELECT -s_suppkey, lpad(CAST(s_suppkey * 104729 % 10000000000 AS VARCHAR), 10, '0') FROM supplier)
  SELECT key, (10 - ({_BIZ} + CAST(substr(x, 9, 1) AS INT) * 5 // 10) % 10) % 10 = CAST(substr(x, 10, 1) AS INT) AS valid FROM c""")
def q18_biz_checksum(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("key"), F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000).cast("string"), 10, "0").alias("x"))
    b = t("supplier").select((-F.col("s_suppkey")).alias("key"), F.lpad((F.col("s_suppkey") * 104729 % 10_000_000_000).cast("string"), 10, "0").alias("x"))
    return a.unionByName(b).select("key", text.biz_number_valid(F.col("x")).alias("valid"))


@query(r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[0-9][0-9,.:-]*[0-9]|[0-9]'))) AS BIGINT) AS n,
  md5(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9][0-9,.:-]*[0-9]|[0-9]'))), ' ')) AS tokens FROM documents""")
def q19_number_tokens(t, spark):
    d = t("documents").select("doc_id", text.number_tokens(F.col("text")).alias("x"))
    return d.select("doc_id", big(F.size("x")).alias("n"), F.md5(F.array_join(F.array_sort("x"), " ")).alias("tokens"))


@query(r"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
  w AS (SELECT conv_id, turn, regexp_replace(prev, '[^\p{L}\p{N}]+', '', 'g') || '|' AS pool, list_distinct(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS ws,
    list_distinct(regexp_extract_all(text, '[0-9][0-9,.:-]*[0-9]|[0-9]')) AS ns, list_distinct(regexp_extract_all(prev, '[0-9][0-9,.:-]*[0-9]|[0-9]')) AS old FROM p WHERE prev IS NOT NULL)
  SELECT conv_id, turn, CAST(len(list_filter(ws, lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g') <> '' AND NOT contains(pool, regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')))) AS BIGINT) AS new_words,
    CAST(len(list_filter(ns, lambda x: NOT list_contains(old, x))) AS BIGINT) AS new_numbers FROM w""")
def q20_new_items(t, spark):
    from pyspark.sql import Window

    p = t("conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    made = text.new_items(F.col("text"), F.col("prev"), F.lit(""))
    return text.composed(p, "text", "prev").select("conv_id", "turn", made.alias("m")).select("conv_id", "turn", big(F.size("m.words")).alias("new_words"), big(F.size("m.numbers")).alias("new_numbers"))


@query(r"""WITH w AS (SELECT unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS w FROM documents)
  SELECT CASE WHEN regexp_matches(w, '[가-힣]') THEN 'hangul' WHEN regexp_full_match(w, '[0-9\s.,:/()-]+') THEN 'number' ELSE 'other' END AS kind, count(*) AS n FROM w WHERE w <> '' GROUP BY 1""")
def q12_word_kind_hist(t, spark):
    words = t("documents").select(F.explode(F.split(text.normalize(F.col("text")), " ")).alias("w")).where("w <> ''")
    return words.groupBy(text.word_kind(F.col("w")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark)
  SELECT ch, count(*) AS n FROM c WHERE ch NOT IN (SELECT ch FROM b) AND NOT regexp_full_match(ch, '\s*') GROUP BY ch""")
def q13_char_dictionary_coverage(t, spark):
    dictionary = t("benchmark").select(F.explode(F.split("text", "")).alias("ch"))
    return scoring.missing_characters(t("documents"), dictionary)


@query(r"""WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark),
  u AS (SELECT ch, count(*) AS n FROM c WHERE NOT regexp_full_match(ch, '\s*') GROUP BY ch), l AS (SELECT * FROM u WHERE ch NOT IN (SELECT ch FROM b))
  SELECT (SELECT count(*) FROM u) AS kinds, (SELECT CAST(sum(n) AS BIGINT) FROM u) AS characters, (SELECT count(*) FROM b WHERE ch <> '') AS dictionary, (SELECT count(*) FROM b WHERE regexp_full_match(ch, '[가-힣]')) AS hangul,
    (SELECT count(*) FROM l) AS lost_kinds, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM l) AS lost, round((SELECT coalesce(sum(n), 0) FROM l) / (SELECT sum(n) FROM u), 9) AS lost_share,
    (SELECT string_agg(ch || n, ' ' ORDER BY n DESC, ch) FROM (SELECT * FROM l ORDER BY n DESC, ch LIMIT 15)) AS top""")
def q89_dictionary_report(t, spark):
    """What the benchmark's characters lack of those in the documents."""
    dictionary = t("benchmark").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    r = scoring.dictionary_coverage(t("documents"), dictionary)
    top = F.nullif(F.array_join(F.transform("top", lambda x: F.concat(x["ch"], x["n"].cast("string"))), " "), F.lit(""))
    return r.select("kinds", "characters", "dictionary", "hangul", "lost_kinds", "lost", F.round("lost_share", 9).alias("lost_share"), top.alias("top"))


@query("""SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source) AS INT) AS rank FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 3)""")
def q90_label_histogram(t, spark):
    """The three most frequent sources of documents."""
    return scoring.histogram(t("documents"), "source", 3)


_PHONES = r"regexp_replace({}, '\b(0[0-9]{{1,2}})[ .]([0-9]{{3,4}})[ .]([0-9]{{4}})\b', '\1-\2-\3', 'g')".format(_DIGITS)


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, translate(CAST(l_partkey * 10007 + l_suppkey AS VARCHAR), '0158', 'OlSB') || '.' || CAST(l_orderkey AS VARCHAR) || ' × 02 123 4567' AS y FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, replace(y, '×', 'x') AS x FROM d)
  SELECT l_orderkey, l_linenumber, {_PHONES} AS fixed FROM f""")
def q91_rules_composed(t, spark):
    """All repair rules in their order."""
    number = F.translate((F.col("l_partkey") * 10007 + F.col("l_suppkey")).cast("string"), "0158", "OlSB")
    return t("lineitem").select("l_orderkey", "l_linenumber", text.apply_rules(F.concat(number, F.lit("."), F.col("l_orderkey").cast("string"), F.lit(" × 02 123 4567"))).alias("fixed"))


@query("""WITH s AS (SELECT doc_id, list_reduce(list_prepend('', string_split(text, chr(10))), lambda a, l:
    CASE WHEN string_split(a, chr(1))[-1] <> '' AND length(string_split(a, chr(1))[-1]) + length(l) > 400 THEN a || chr(1) || l
         WHEN string_split(a, chr(1))[-1] = '' THEN a || l ELSE a || chr(10) || l END) AS x FROM documents),
  c AS (SELECT doc_id, unnest(string_split(x, chr(1))) AS chunk, generate_subscripts(string_split(x, chr(1)), 1) - 1 AS no FROM s)
  SELECT doc_id, CAST(no AS INT) AS no, md5(chunk) AS chunk, CAST(length(chunk) AS BIGINT) AS n FROM c WHERE trim(chunk) <> ''""")
def q38_chunks(t, spark):
    return retrieval.chunk_documents(t("documents"), 400).select("doc_id", "no", F.md5("text").alias("chunk"), big(F.length("text")).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT md5(line) AS line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(*) > 1""")
def q60_line_dedupe(t, spark):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    per_doc = lines.groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("line").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs")).where("n > 1").select(F.md5("line").alias("line"), "n", "docs")


@query(r"""WITH x AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '전자 세금 계산서' WHEN 1 THEN '공급자 공급 받는자' WHEN 2 THEN '합 계 10 승인번호' WHEN 3 THEN '합계' ELSE '' END || chr(10) || html AS text FROM pages),
  l AS (SELECT page_id, text, regexp_replace(text, '\s+', '', 'g') AS flat, string_split(text, chr(10)) AS ls FROM x),
  n AS (SELECT *, list_transform(ls, lambda x: len(string_split(x, ' '))) AS ns FROM l)
  SELECT page_id, CASE WHEN contains(flat, '세금계산서') OR (contains(flat, '공급자') AND contains(flat, '공급받는자')) THEN 'invoice' WHEN contains(flat, '합계') AND regexp_matches(flat, '거래일시|영수증|부가세|승인번호') THEN 'receipt'
    WHEN (regexp_matches(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+') OR regexp_matches(text, '0[0-9]{1,2}\s?[-–.)]\s?[0-9]{3,4}\s?[-–.]\s?[0-9]{4}')) AND len(ls) <= 12 AND page_id % 2 = 0 THEN 'card'
    WHEN len(list_filter(ns, lambda n: n >= 3)) >= 3 AND list_sum(list_filter(ns, lambda n: n >= 3)) >= 0.6 * len(ls) THEN 'table' ELSE 'document' END AS type FROM n""")
def q46_document_type(t, spark):
    """Types of pages by rules; some pages begin with words of an invoice or a receipt, half have the shape of a card."""
    k = F.col("page_id")
    word = F.when(k % 7 == 0, "전자 세금 계산서").when(k % 7 == 1, "공급자 공급 받는자").when(k % 7 == 2, "합 계 10 승인번호").when(k % 7 == 3, "합계").otherwise("")
    p = t("pages").select("page_id", F.concat(word, F.lit("\n"), "html").alias("text")).withColumn("lines", F.split("text", "\n"))
    sizes = F.transform("lines", lambda x: F.size(F.split(x, " ")))
    kind = routing.document_type(F.col("text"), F.size("lines"), F.when(k % 2 == 0, 1.6).otherwise(1.0), F.lit(1.0), sizes)
    return p.select("page_id", kind["type"].alias("type"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# ' || text || ' **bold** <b>' || lang || '</b> ![i](u)', '!\[[^\]]*\]\([^)]*\)', '', 'g'), '^#{1,6}\s+', '', 'gm'), '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '<[^>]+>', '', 'g')) AS plain FROM documents""")
def q61_strip_markup(t, spark):
    marked = F.concat(F.lit("# "), "text", F.lit(" **bold** <b>"), "lang", F.lit("</b> ![i](u)"))
    return t("documents").select("doc_id", F.md5(text.strip_markup(marked)).alias("plain"))


@query()
def q44_compression_ratio(t, spark):
    """Documents that repeat themselves, by the ratio of compression."""
    d = t("documents").select("doc_id", metrics.compression_ratio("text").alias("ratio"))
    return d.select("doc_id", r6("ratio").alias("ratio"), (F.col("ratio") > 4).alias("repeats"))


@query()
def q48_markdown_to_text(t, spark):
    """Pages as text and tables."""
    d = t("pages").select("page_id", tables.markdown_to_text(F.concat("html", F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\n"))).alias("m"))
    return d.select("page_id", F.md5("m.text").alias("text"), big(F.size("m.html_tables")).alias("html_tables"), big(F.size("m.md_tables")).alias("md_tables"))


@query()
def q62_block_text(t, spark):
    """Text of whole pages as layout blocks."""
    return t("pages").select("page_id", F.md5(tables.html_block_text("html")).alias("text"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def q59_json_props(t, spark):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "event_type")


@query("""SELECT event_id, event_type || '|' || props AS strings FROM events""")
def q63_json_strings(t, spark):
    """Strings of nested JSON in order."""
    j = F.to_json(F.struct("event_type", F.struct(F.lit("text").alias("type"), F.col("props").alias("content")).alias("block")))
    return t("events").select("event_id", F.array_join(jsontext.json_strings(j), "|").alias("strings"))


_DAMAGED = "CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 10 AS d"


@query(f"""WITH e AS (SELECT event_id, event_type, {_DAMAGED} FROM events),
  p AS (SELECT *, CASE WHEN d = 3 THEN 'not json' WHEN d = 4 THEN 'wrong type' WHEN d = 5 THEN 'missing field' WHEN d = 7 THEN 'empty' WHEN d = 2 THEN 'missing field' END AS error FROM e)
  SELECT event_id, CASE WHEN error IS NULL THEN event_id END AS id, CASE WHEN error IS NULL THEN event_type END AS kind, CASE WHEN error IS NULL THEN k END AS k, CASE WHEN error IS NULL AND d <> 9 THEN 'n' END AS note, error IS NULL AND d = 1 AS repaired, error FROM p""")
def q97_answers(t, spark):
    """Answers as a model gives them, some damaged: in a code fence, cut off, chatting, of a wrong type, without a field, empty."""
    e = t("events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"), (F.col("event_id") % 10).alias("d"))
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("k"), F.lit("n").alias("note"), F.array(F.lit("a \"b\" {")).alias("other")))
    part = lambda *names: F.to_json(F.struct(*names))
    text = (
        F.when(F.col("d") == 1, F.substring_index(whole, " {", 1))
        .when(F.col("d") == 2, F.substring_index(whole, "kind", 1))
        .when(F.col("d") == 3, F.lit("I can't read this."))
        .when(F.col("d") == 4, part(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit("many").alias("k")))
        .when(F.col("d") == 5, part(F.col("event_id").alias("id"), F.col("k")))
        .when(F.col("d") == 6, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\nDone.")))
        .when(F.col("d") == 8, F.concat(F.lit("Sure. "), whole, F.lit(" That is all.")))
        .when(F.col("d") == 9, part(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("k")))
        .when(F.col("d") != 7, whole)
    )
    p = answers.parse_answers(e.withColumn("text", text), "id bigint, kind string, k bigint, note string", ["id", "kind", "k"])
    return p.select("event_id", "answer.id", "answer.kind", "answer.k", "answer.note", "repaired", F.col("_error").alias("error"))


@query("""SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, md5(string_agg(conv_id || '-' || turn, ',' ORDER BY conv_id, turn)) AS ids, count(*) FILTER (WHERE turn % 5 = 0) AS errors, (SELECT count(*) FROM conversations) AS written FROM conversations GROUP BY role""")
def q99_result_files(t, spark):
    """Turns written as result files and read back by stretches of bytes, with what the metadata says of them."""
    results.register_results(spark)
    c = t("conversations")
    path = scratch(spark, "results")
    key = F.concat_ws("|", "conv_id", "turn", "role")
    out = c.select(key.alias("id"), "text", F.array("role").alias("tables"), F.col("turn").cast("double").alias("time"), (F.col("turn") % 5 == 0).alias("error"))
    out.write.format("result_files").mode("append").option("meta.engine", "turns").save(path)
    back = spark.read.format("result_files").option("split", 50_000).load(path)
    n = spark.read.format("result_files").option("meta", "true").load(path).agg(F.sum(F.get_json_object("meta", "$.n").cast("bigint")).alias("written"))
    parts = back.select(F.split("id", "\\|").alias("k"), F.length("text").alias("chars"), "error").select(F.col("k")[0].cast("bigint").alias("conv_id"), F.col("k")[1].cast("int").alias("turn"), F.col("k")[2].alias("role"), "chars", "error")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn"))), lambda x: F.concat_ws("-", x["conv_id"], x["turn"])), ",")
    found = parts.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.md5(ids).alias("ids"), F.count_if("error").alias("errors"))
    return found.crossJoin(F.broadcast(n))


@query("""SELECT lang, doc_id, source FROM (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 5""")
def q54_first_n_per_group(t, spark):
    return sampling.first_n_per_group(t("documents").select("lang", "doc_id", "source"), 5, "lang", "doc_id")


@query("""SELECT doc_id, lang, md5(text) AS text FROM (SELECT doc_id, lang, text, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % 3 = 1""")
def q64_every_kth(t, spark):
    return sampling.every_kth(t("documents"), 3, 1, "doc_id").select("doc_id", "lang", F.md5("text").alias("text"))


@query("""SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q53_cache_antijoin(t, spark):
    return corpus.missing_from_cache(t("documents"), t("labels"), "doc_id").select("doc_id", "lang")


@query("""SELECT a.doc_id, b.parent FROM documents a JOIN (SELECT text, min(doc_id) AS parent, count(*) AS n FROM documents GROUP BY text) b ON a.text = b.text WHERE b.n > 1 AND a.doc_id <> b.parent""")
def q57_parent_selfjoin(t, spark):
    return corpus.copies_of(t("documents"), "doc_id", "text")


@query("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
  SELECT conv_id, turn, CASE WHEN NOT contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(split_part(text, '.', 1), '\\s+', '', 'g')) THEN 'answer not in text'
    WHEN contains(regexp_replace(q, '\\s+', '', 'g'), regexp_replace(split_part(text, '.', 1), '\\s+', '', 'g')) THEN 'answer in question'
    WHEN length(regexp_replace(split_part(text, '.', 1), '\\s+', '', 'g')) NOT BETWEEN 2 AND 40 THEN 'length' ELSE 'kept' END AS reason FROM p WHERE q IS NOT NULL""")
def q43_qa_accept(t, spark):
    from pyspark.sql import Window

    p = t("conversations").withColumn("q", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("q is not null")
    return p.select("conv_id", "turn", extraction.accept_question(F.col("q"), F.split_part("text", F.lit("."), F.lit(1)), F.col("text")).alias("reason"))
