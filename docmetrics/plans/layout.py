"""Queries over boxes, rows and tables, made from line items by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import affine, box, order_corners, padded, poly_to_box
from ..operators import matching, rows, tables
from ..sources import corpus, pages
from .registry import query, r6

# Line numbers repeat within an order, so lines are made unique first.
_LINES = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"
_PRED = f"SELECT l_orderkey AS id, l_linenumber AS pred, (l_partkey % 50) * 10.0::DOUBLE AS x1, l_linenumber * 20.0::DOUBLE + l_suppkey % 7 AS y1, (l_partkey % 50) * 10.0::DOUBLE + 40 + l_quantity AS x2, l_linenumber * 20.0::DOUBLE + 15 + l_suppkey % 5 + l_suppkey % 7 AS y2 FROM {_LINES}"
_GT = f"SELECT l_orderkey AS id, l_linenumber AS gt, (l_partkey % 50) * 10.0::DOUBLE + l_partkey % 13 AS x1, l_linenumber * 20.0::DOUBLE + l_partkey % 6 AS y1, (l_partkey % 50) * 10.0::DOUBLE + 45 + l_quantity AS x2, l_linenumber * 20.0::DOUBLE + 17 + l_partkey % 6 AS y2 FROM {_LINES}"
_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_IOU = f"({_INTER}) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER})"


def _lines(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))


def _pred(t):
    x, y = (F.col("l_partkey") % 50) * 10.0, F.col("l_linenumber") * 20.0 + F.col("l_suppkey") % 7
    b = box(x, y, x + 40 + F.col("l_quantity"), y + 15 + F.col("l_suppkey") % 5)
    return _lines(t).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pred"), b.alias("box"))


def _gt(t):
    x, y = (F.col("l_partkey") % 50) * 10.0, F.col("l_linenumber") * 20.0 + F.col("l_partkey") % 6
    b = box(x + F.col("l_partkey") % 13, y, x + 45 + F.col("l_quantity"), y + 17)
    return _lines(t).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("gt"), b.alias("box"))


@query(f"""WITH a AS ({_PRED}), b AS ({_GT}), p AS (SELECT a.id, a.pred, b.gt, {_IOU} AS iou FROM a JOIN b ON a.id = b.id),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, pred ORDER BY iou DESC, gt) AS k FROM p WHERE iou >= 0.5)
  SELECT a.id, a.pred, k.gt, round(k.iou, 6) AS iou FROM a LEFT JOIN k ON a.id = k.id AND a.pred = k.pred AND k.k = 1""")
def q27_iou_best_match(t, spark):
    return matching.best_match(_pred(t), _gt(t)).select("id", "pred", "gt", r6("iou").alias("iou"))


def _greedy(first: str, second: str) -> str:
    """SQL for greedy matches: a fold over a document's pairs in their order, each kept if neither side is used yet."""
    return f"""a AS ({_PRED}), b AS ({_GT}), p AS (SELECT a.id, a.pred, b.gt, {_IOU} AS iou FROM a JOIN b ON a.id = b.id),
  o AS (SELECT id, list([struct_pack(a := {first}, b := {second})] ORDER BY {first}, iou DESC, {second} DESC) AS l FROM p WHERE iou >= 0.5 GROUP BY id),
  m AS (SELECT id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda g: g.a = x[1].a OR g.b = x[1].b)) > 0 THEN acc ELSE acc || x END)) AS m FROM o)"""


@query(f"""WITH {_greedy("pred", "gt")}, s AS (SELECT (SELECT count(*) FROM m) AS hits, (SELECT count(*) FROM a) AS n_pred, (SELECT count(*) FROM b) AS n_gt)
  SELECT hits, n_pred, n_gt, round(hits / n_pred, 6) AS precision, round(hits / n_gt, 6) AS recall, round(2 * (hits / n_pred) * (hits / n_gt) / (hits / n_pred + hits / n_gt), 6) AS f1 FROM s""")
def q28_greedy_match_pred(t, spark):
    """Matches driven by predictions, with scores."""
    s = matching.detection_scores(matching.detection_counts(_pred(t), _gt(t), "pred"))
    return s.select("hits", "n_pred", "n_gt", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {_greedy("gt", "pred")} SELECT id, CAST(m.b AS BIGINT) AS pred, CAST(m.a AS BIGINT) AS gt FROM m""")
def q29_greedy_match_truth(t, spark):
    """Matches driven by true boxes."""
    return matching.greedy_match(_pred(t), _gt(t), "truth")


_ROW = "(least(r.y2, x[1].y2) - greatest(r.y1, x[1].y1) > 0.5 * least(r.y2 - r.y1, x[1].y2 - x[1].y1))"


@query(f"""WITH a AS ({_PRED}), o AS (SELECT id, list([struct_pack(y1 := y1, y2 := y2, m := [struct_pack(x := x1, p := pred)])] ORDER BY y1, pred) AS l FROM a GROUP BY id),
  g AS (SELECT id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda r: {_ROW})) = 0 THEN acc || x
    ELSE list_transform(acc, lambda r, i: CASE WHEN i = list_position(list_transform(acc, lambda r: {_ROW}), true) THEN struct_pack(y1 := r.y1, y2 := r.y2, m := r.m || x[1].m) ELSE r END) END) AS rows FROM o)
  SELECT id, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(list_sort(r.m), lambda m: CAST(m.p AS VARCHAR)), ',')), '|') AS rows FROM g""")
def q30_row_grouping(t, spark):
    """Rows of the boxes of every order."""
    p = _pred(t).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pred", "box"))).alias("lines"))
    g = rows.group_rows(F.col("lines"))
    return p.select("id", F.transform(g, lambda r: F.array_join(F.transform(r, lambda m: m["pred"].cast("string")), ",")).alias("r")).select("id", F.array_join("r", "|").alias("rows"))


@query(f"""WITH a AS ({_PRED}), w AS (SELECT *, lag(y2) OVER o AS py2, lag(y1) OVER o AS py1, lag(x1) OVER o AS px1 FROM a WINDOW o AS (PARTITION BY id ORDER BY pred)),
  b AS (SELECT *, CASE WHEN py2 IS NOT NULL AND (y1 > py2 - (py2 - py1) * 0.3 OR x1 < px1) THEN 1 ELSE 0 END AS brk FROM w),
  l AS (SELECT id, pred, sum(brk) OVER (PARTITION BY id ORDER BY pred) AS line_no FROM b)
  SELECT id, CAST(line_no AS BIGINT) AS line_no, string_agg('w' || pred, ' ' ORDER BY pred) AS text FROM l GROUP BY ALL""")
def q31_line_reconstruct(t, spark):
    w = _pred(t).select("id", F.col("pred").alias("word_no"), F.concat(F.lit("w"), F.col("pred").cast("string")).alias("text"), "box")
    return rows.reconstruct_lines(w)


@query("""WITH m AS (SELECT *, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  r AS (SELECT *, sum(b) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM m)
  SELECT o_custkey, CAST(run AS BIGINT) AS run, o_orderstatus, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY ALL""")
def q32_rowspan_runs(t, spark):
    return rows.runs(t("orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus")


@query(f"""WITH a AS ({_PRED}), b AS ({_GT}), p AS (SELECT a.id, a.pred, a.x1 AS x, b.gt, ({_INTER}) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS ratio FROM a JOIN b ON a.id = b.id),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, pred ORDER BY ratio DESC, gt) AS k FROM p WHERE ratio >= 0.5)
  SELECT id, gt AS line, string_agg('t' || pred, ' ' ORDER BY x, pred) AS text FROM k WHERE k = 1 GROUP BY ALL""")
def q71_assign_pieces(t, spark):
    other = _pred(t).select("id", F.col("pred").alias("piece"), F.concat(F.lit("t"), F.col("pred").cast("string")).alias("text"), "box")
    anchor = _gt(t).select("id", F.col("gt").alias("line"), "box")
    return matching.assign_pieces(anchor, other)


@query(f"""WITH a AS ({_PRED}) SELECT id, l.block, l.line, string_agg('w' || pred, ' ' ORDER BY pred) AS text, round(avg(pred) / 100, 6) AS score, min(x1) AS x1, max(x2) AS x2
  FROM a, (SELECT 0) z, LATERAL (SELECT pred % 2 AS block, pred % 3 AS line) l GROUP BY ALL""")
def q72_words_to_lines(t, spark):
    w = _pred(t).select("id", (F.col("pred") % 2).alias("block"), F.lit(0).alias("par"), (F.col("pred") % 3).alias("line"), F.col("pred").alias("i"), F.concat(F.lit("w"), F.col("pred").cast("string")).alias("text"), F.col("pred").alias("conf"), "box")
    return rows.words_to_lines(w).select("id", "block", "line", "text", r6("score").alias("score"), "x1", "x2")


_SECTION = "CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 2 THEN 2 ELSE 1 END"


@query(f"""SELECT l_orderkey AS id, string_agg('b' || l_linenumber, chr(10) || chr(10) ORDER BY {_SECTION}, CASE WHEN l_linenumber % 3 = 1 THEN 0 ELSE l_quantity END, l_linenumber) AS text FROM {_LINES} GROUP BY 1""")
def q52_reading_order(t, spark):
    n = F.col("l_linenumber")
    section = F.when(n % 3 == 0, "header").when(n % 3 == 2, "footer").otherwise("body")
    b = _lines(t).select(F.col("l_orderkey").alias("id"), n.alias("pos"), section.alias("section"), F.col("l_quantity").alias("y"), F.concat(F.lit("b"), n.cast("string")).alias("text"))
    return rows.reading_order(b)


@query(f"""WITH a AS ({_PRED}) SELECT id, pred, round(x1 * 0.5 - y1 * 0.25 + 3, 6) AS ax, round(x1 * 0.25 + y1 * 0.5 - 2, 6) AS ay, greatest(0, x1 - greatest(4, floor(0.15 * (y2 - y1)))) AS px, least(500, x2 + greatest(4, floor(0.15 * (y2 - y1)))) AS qx FROM a""")
def q73_box_geometry(t, spark):
    b = F.col("box")
    poly = F.array(F.array(b["x1"], b["y1"]), F.array(b["x2"], b["y1"]), F.array(b["x2"], b["y2"]), F.array(b["x1"], b["y2"]))
    around = poly_to_box(order_corners(poly))
    pad = padded(around, F.lit(500.0), F.lit(500.0))
    moved = affine(poly, [0.5, -0.25, 3, 0.25, 0.5, -2])
    return _pred(t).select("id", "pred", r6(moved[0][0]).alias("ax"), r6(moved[0][1]).alias("ay"), pad["x1"].alias("px"), pad["x2"].alias("qx"))


def _markup(t):
    """A table of every customer's orders, the customer in one cell over all rows."""
    g = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("os"))
    first = F.concat(F.lit("<tr><td rowspan="), F.size("os").cast("string"), F.lit(">c"), F.col("id").cast("string"), F.lit("</td>"))
    cells = F.transform("os", lambda x, i: F.concat(F.when(i == 0, first).otherwise("<tr>"), F.lit("<td>"), x["o_orderkey"].cast("string"), F.lit("</td><td> "), x["o_orderpriority"], F.lit(" </td></tr>")))
    return g.select("id", F.concat(F.lit("<table><tr><th>customer</th><th>key</th><th>priority</th></tr>"), F.array_join(cells, ""), F.lit("</table>")).alias("html"), "os")


_ORDERS = "g AS (SELECT o_custkey AS id, list_sort(list(struct_pack(k := o_orderkey, n := o_orderpriority))) AS os FROM orders GROUP BY ALL)"


@query(f"""WITH {_ORDERS} SELECT id, 'customer|key|priority|c' || id || '|' || array_to_string(list_transform(os, lambda x: CAST(x.k AS VARCHAR) || '|' || trim(x.n)), '|') AS cells FROM g""")
def q47_html_cells(t, spark):
    return _markup(t).select("id", F.array_join(tables.html_cells("html"), "|").alias("cells"))


@query(f"""WITH {_ORDERS} SELECT id, 'customer|key|priority' || chr(10) || array_to_string(list_transform(os, lambda x: 'c' || id || '|' || CAST(x.k AS VARCHAR) || '|' || trim(x.n)), chr(10)) AS grid FROM g""")
def q49_table_grid(t, spark):
    g = _markup(t).select("id", tables.table_grid("html").alias("g"))
    return g.select("id", F.array_join(F.transform("g", lambda r: F.array_join(r, "|")), "\n").alias("grid"))


@query("""WITH n AS (SELECT s_suppkey // 4 AS id, count(*) AS n FROM supplier GROUP BY 1) SELECT id, 1.0::DOUBLE AS same, round(1 - 1.0::DOUBLE / (3 * n), 6) AS less, round(1 - n / (3.0::DOUBLE * n), 6) AS other, 1.0::DOUBLE AS structure FROM n""")
def q50_teds(t, spark):
    """Similarity of tables of four suppliers each to themselves, to one with a cell less, and to one with other text in a column."""
    row = F.struct("s_suppkey", F.concat(F.lit("<tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</td><td>xyz</td></tr>")).alias("html"))
    g = t("supplier").groupBy(F.floor(F.col("s_suppkey") / 4).cast("bigint").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("rs"))
    m = g.select("id", F.concat(F.lit("<table>"), F.array_join(F.transform("rs", lambda r: r["html"]), ""), F.lit("</table>")).alias("html"))
    m = m.withColumn("less", F.concat(F.regexp_replace("html", "<td>xyz</td></tr></table>$", ""), F.lit("</tr></table>")))
    m = m.withColumn("other", F.replace("html", F.lit("xyz"), F.lit("abc")))
    return m.select("id", r6(tables.teds("html", "html")).alias("same"), r6(tables.teds("less", "html")).alias("less"), r6(tables.teds("other", "html")).alias("other"), r6(tables.teds_structure("other", "html")).alias("structure"))


@query(f"""WITH g AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS r, l_partkey, l_suppkey FROM {_LINES}),
  c AS (SELECT id, r, 0 AS c, CAST(l_partkey AS VARCHAR) AS want, CAST(CASE WHEN l_partkey % 10 = 0 THEN l_partkey + 1 ELSE l_partkey END AS VARCHAR) AS got FROM g
    UNION ALL SELECT id, r, 1, CAST(l_suppkey AS VARCHAR), CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE ' ' || CAST(l_suppkey AS VARCHAR) END FROM g)
  SELECT id, round(avg((coalesce(want = trim(got), false))::INT), 6) AS accuracy FROM c GROUP BY id""")
def q51_cell_accuracy(t, spark):
    li = _lines(t).select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey")
    want = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    got = F.array(F.when(F.col("l_partkey") % 10 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).cast("string"), F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit(" "), F.col("l_suppkey").cast("string"))))
    collect = lambda cells: li.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("cells")))), lambda x: x["cells"]).alias("rows"))
    return tables.cell_accuracy(collect(want), collect(got)).select("id", r6("accuracy").alias("accuracy"))


@query(f"""WITH {_ORDERS} SELECT id, 'key/priority' AS header, array_to_string(list_transform(os, lambda x: CAST(x.k AS VARCHAR) || '/' || x.n), ';') AS rows FROM g""")
def q74_markdown_rows(t, spark):
    lines = F.array_join(F.transform("os", lambda x: F.concat(F.lit("| "), x["o_orderkey"].cast("string"), F.lit(" | "), x["o_orderpriority"], F.lit(" |"))), "\n")
    m = tables.markdown_rows(F.concat(F.lit("intro\n| key | priority |\n|---|:-:|\n"), lines, F.lit("\nend")))
    return _markup(t).select("id", m.alias("m")).select("id", F.array_join("m.header", "/").alias("header"), F.array_join(F.transform("m.rows", lambda r: F.array_join(r, "/")), ";").alias("rows"))


@query(f"""WITH {_ORDERS} SELECT id, '<table><tr><th>key</th><th>priority</th></tr>' || array_to_string(list_transform(os, lambda x: '<tr><td>' || x.k || '</td><td>' || x.n || '</td></tr>'), '') || '</table>' AS html FROM g""")
def q75_rows_html(t, spark):
    rows_ = F.transform("os", lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderpriority"]))
    table = F.struct(F.array(F.lit("key"), F.lit("priority")).alias("header"), rows_.alias("rows"))
    return _markup(t).select("id", tables.rows_html(table).alias("html"))


@query("""WITH a AS (SELECT l_orderkey AS id, l_linenumber AS pos, 'p' || l_partkey AS want FROM lineitem), b AS (SELECT l_orderkey AS id, l_linenumber AS pos, 'p' || l_partkey AS got FROM lineitem WHERE l_linenumber % 3 <> 0)
  SELECT a.id, a.pos, want, coalesce(got, '') AS got FROM a LEFT JOIN b USING (id, pos)""")
def q58_positional_zip(t, spark):
    li = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("v"))
    got = li.where("pos % 3 <> 0").withColumnRenamed("v", "got")
    return corpus.by_position(li.withColumnRenamed("v", "want"), got)


def sections(data: bytes) -> list[str]:
    """Stands for a parser of paged files: the stretches of a page's markup up to the ends of its paragraphs."""
    if not data.startswith(b"<"):
        raise ValueError("no markup")
    return data.decode().split("</p>")


@query(r"""WITH d AS (SELECT page_id, CASE WHEN page_id % 9 = 4 THEN substr(html, 2) WHEN page_id % 9 > 0 THEN html END AS h FROM pages),
  e AS (SELECT *, CASE WHEN h IS NULL THEN 'no data' WHEN strlen(h) > 6000 THEN 'more than 6000 bytes' WHEN h[1] <> '<' THEN 'not opened: no markup' WHEN len(string_split(h, '</p>')) > 12 THEN 'more than 12 pages' END AS error FROM d),
  s AS (SELECT page_id, string_split(h, '</p>') AS parts, unnest(range(1, len(string_split(h, '</p>')) + 1)) AS page FROM e WHERE error IS NULL),
  t AS (SELECT page_id, page, regexp_replace(replace(parts[page], chr(13) || chr(10), chr(10)), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM s)
  SELECT page_id, CAST(NULL AS INT) AS page, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS text, error FROM e WHERE error IS NOT NULL
  UNION ALL SELECT page_id, CAST(page AS INT), CASE WHEN length(text) >= 40 THEN 'text' ELSE 'ocr' END, CASE WHEN length(text) >= 40 THEN md5(text) END, NULL FROM t""")
def q98_document_pages(t, spark):
    """Files cut into pages by a table function with limits: some are missing, too large, of too many pages, or can't be opened."""
    pages.register_pages(spark)
    html = F.when(F.col("page_id") % 9 == 4, F.expr("substr(html, 2)")).when(F.col("page_id") % 9 > 0, F.col("html"))
    files = t("pages").select("page_id", F.encode(html, "UTF-8").alias("content"))
    return spark.sql("SELECT page_id, page, source, md5(text) AS text, error FROM {files}, LATERAL document_pages(content, 'docmetrics.plans.layout:sections', 12, 6000, 40)", files=files)
