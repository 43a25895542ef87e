"""Queries over sequences, histograms, integrity, text, links and nested rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.functions import text as tx
from quireflow.operators.sequences import gaps, islands, largest_gap, runs_from_one, with_previous
from quireflow.plans.registry import query
from quireflow.sources.tables import read


@query("font_hints", "SELECT p_brand, p_size AS size, n, r AS place FROM (SELECT p_brand, p_size, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS r FROM part GROUP BY p_brand, p_size) WHERE r <= 3 AND n >= 3")
def font_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most common sizes of each brand with at least three samples, first seen on ties."""
    counted = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("seen"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "seen"))
    return counted.withColumn("place", place).filter("place <= 3 AND n >= 3").select("p_brand", "size", "n", "place")


_HINTS = """CASE WHEN ids > 3 THEN least(0.95::DOUBLE, 0.6::DOUBLE + ids / 100) WHEN ids > 0 THEN least(0.5::DOUBLE, 0.2::DOUBLE + ids / 50) ELSE 0.0::DOUBLE END AS catalog,
CASE WHEN sn > 0 AND pc > 0 THEN 0.9 WHEN sn > 0 THEN 0.8 WHEN pc > 5 AND ids < 10 THEN 0.7 WHEN pc > 0 AND ids = 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS instruction,
CASE WHEN pc = 0 AND ids = 0 THEN 0.8 WHEN pc < 3 AND ids < 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS info"""


@query("page_hints", f"WITH c AS (SELECT l_orderkey AS page, count(*) FILTER (l_returnflag = 'A') AS ids, count(*) FILTER (l_returnflag = 'N') AS pc, count(*) FILTER (l_returnflag = 'R') AS sn FROM lineitem GROUP BY 1), h AS (SELECT page, {_HINTS} FROM c) SELECT *, CASE WHEN catalog >= instruction AND catalog >= info THEN 'catalog' WHEN instruction >= info THEN 'instruction' ELSE 'info' END AS best FROM h")
def page_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences of three page types from counts, and the best (catalogue first on ties)."""
    flag = F.col("l_returnflag")
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count_if(flag == "A").alias("ids"), F.count_if(flag == "N").alias("pc"), F.count_if(flag == "R").alias("sn"))
    ids, pc, sn = F.col("ids"), F.col("pc"), F.col("sn")
    catalog = F.when(ids > 3, F.least(F.lit(0.95), F.lit(0.6) + ids / 100)).when(ids > 0, F.least(F.lit(0.5), F.lit(0.2) + ids / 50)).otherwise(0.0)
    instruction = F.when((sn > 0) & (pc > 0), 0.9).when(sn > 0, 0.8).when((pc > 5) & (ids < 10), 0.7).when((pc > 0) & (ids == 0), 0.6).otherwise(0.0)
    info = F.when((pc == 0) & (ids == 0), 0.8).when((pc < 3) & (ids < 3), 0.5).otherwise(0.0)
    h = c.select("page", catalog.alias("catalog"), instruction.alias("instruction"), info.alias("info"))
    best = F.when((F.col("catalog") >= F.col("instruction")) & (F.col("catalog") >= F.col("info")), "catalog").when(F.col("instruction") >= F.col("info"), "instruction").otherwise("info")
    return h.withColumn("best", best)


@query("yearly_index", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def yearly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").filter("o_orderdate IS NOT NULL")
    return orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("theme_balanced")
def theme_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per size the four brands least used so far: a running state over (size, brand) counts."""
    themes = read(spark, sf_dir, "part").groupBy("p_size", "p_brand").agg(F.min("p_partkey").alias("first_part"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        out = []
        for size, rows in pdf.sort_values(["p_size", "p_brand"]).groupby("p_size"):
            for brand, part in sorted(zip(rows["p_brand"], rows["first_part"], strict=True), key=lambda x: (used.get(x[0], 0), x[0]))[:4]:
                used[brand] = used.get(brand, 0) + 1
                out.append((size, brand, part))
        return pd.DataFrame(out, columns=["p_size", "p_brand", "first_part"])

    # sizes x brands: a table of fixed, small size
    return themes.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fold, "p_size int, p_brand string, first_part long")


@query("type_label_summary", "SELECT d.lang, l.quality, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(d.lang, l.quality)::BIGINT AS level FROM documents d JOIN labels l USING (doc_id) GROUP BY GROUPING SETS ((d.lang, l.quality), (d.lang), ())")
def type_label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    sets = both.groupingSets([[F.col("lang"), F.col("quality")], [F.col("lang")], []], "lang", "quality")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level")).select("lang", "quality", "n", "chars", "level")


@query("ratio_report", "SELECT source, category, n, round(n / sum(n) OVER (PARTITION BY source) * 100, 4) AS percent FROM (SELECT source, CASE WHEN n_chars < 100 THEN 'tiny' WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS category, count(*) AS n FROM documents GROUP BY 1, 2)")
def ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    category = F.when(n < 100, "tiny").when(n < 1000, "short").when(n < 5000, "medium").otherwise("long")
    counted = read(spark, sf_dir, "documents").groupBy("source", category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")) * 100, 4))


@query("step_gaps", "WITH b AS (SELECT l_orderkey AS page, min(l_linenumber) AS a, max(l_linenumber) AS z FROM lineitem GROUP BY 1), s AS (SELECT page, unnest(range(a, z + 1))::INT AS missing FROM b) SELECT page, missing FROM s WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = page AND l_linenumber = missing)")
def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")), "page", "n").withColumnRenamed("n", "missing")


@query("step_dups", "SELECT l_orderkey AS page, l_linenumber AS step, count(*) AS n, min(l_partkey) AS least_part, list_sort(list(l_partkey))::VARCHAR AS parts FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def step_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("least_part"), F.sort_array(F.collect_list("l_partkey")).alias("p"))
    return found.filter("n > 1").select("page", "step", "n", "least_part", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x.cast("string")), ", "), F.lit("]")).alias("parts"))


@query("seq_islands", "WITH t AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n FROM lineitem), i AS (SELECT page, n, n - row_number() OVER (PARTITION BY page ORDER BY n) AS k FROM t), r AS (SELECT page, min(n) AS a, max(n) AS z FROM i GROUP BY page, k) SELECT page, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ', ' ORDER BY a) AS ranges FROM r GROUP BY page")
def seq_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")), "page", "n")


_EVENTS = "SELECT user_id, event_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"


@query("seq_decrease", f"SELECT user_id, event_id, value, before FROM ({_EVENTS}) WHERE value < before - 0.001")
def seq_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_previous(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").filter("value < before - 0.001").select("user_id", "event_id", "value", "before")


@query("seq_jump", f"SELECT user_id, event_id, value - before AS jump FROM ({_EVENTS}) WHERE value - before > 1")
def seq_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_previous(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").filter("value - before > 1").select("user_id", "event_id", (F.col("value") - F.col("before")).alias("jump"))


@query(
    "increment_cv",
    f"SELECT user_id, bars, n, cv, cv > 1 AS uneven FROM (SELECT user_id, count(*) AS bars, count(*) FILTER (value - before >= 0) AS n, round(CASE WHEN avg(value - before) FILTER (value - before >= 0) > 0 THEN stddev_samp(value - before) FILTER (value - before >= 0) / avg(value - before) FILTER (value - before >= 0) ELSE 0 END, 5) AS cv FROM ({_EVENTS}) GROUP BY user_id) WHERE bars > 5 AND n > 2",
)
def increment_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sequence of more than five values rises unevenly: the spread of its more than two rises exceeds their mean."""
    steps = with_previous(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").withColumn("d", F.col("value") - F.col("before"))
    rise = F.when(F.col("d") >= 0, F.col("d"))
    found = steps.groupBy("user_id").agg(F.count(F.lit(1)).alias("bars"), F.count(rise).alias("n"), F.stddev_samp(rise).alias("sd"), F.avg(rise).alias("m")).filter("bars > 5 AND n > 2")
    cv = F.round(F.when(F.col("m") > 0, F.col("sd") / F.col("m")).otherwise(0.0), 5)
    return found.select("user_id", "bars", "n", cv.alias("cv"), (cv > 1).alias("uneven"))


@query("subassembly_filter", "WITH t AS (SELECT l_orderkey AS page, l_linenumber AS line, l_quantity::INT AS n FROM lineitem), g AS (SELECT *, n - lag(n) OVER (PARTITION BY page ORDER BY n) AS gap, min(n) OVER (PARTITION BY page) AS start FROM t), b AS (SELECT page, n AS cut FROM g WHERE gap > 3 AND start <= 3 QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap DESC, n) = 1) SELECT t.page, t.line, t.n FROM t LEFT JOIN b USING (page) WHERE cut IS NULL OR t.n >= cut")
def subassembly_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines above a page's largest gap, on pages that start at 3 or less; a page that starts higher stays whole."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("n"))
    return largest_gap(lines, "page", "n", 3, 3)


@query("valid_runs", "WITH t AS (SELECT conv_id, turn + 1 AS n, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, n FROM t WHERE n = r")
def valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from_one(read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("n")), "conv_id", "n")


@query("catalog_coverage", "WITH c AS (SELECT p_partkey, p_retailprice FROM part WHERE p_size <= 25), o AS (SELECT l_orderkey AS page, l_partkey IN (SELECT p_partkey FROM c) OR l_suppkey IN (SELECT p_partkey FROM c) AS hit FROM lineitem) SELECT page, count(*) AS n, count(*) FILTER (hit) AS found, round(count(*) FILTER (hit) / count(*) * 100, 4) AS percent FROM o GROUP BY page")
def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in a catalogue by either of two keys: two equi-joins instead of one with OR."""
    known = read(spark, sf_dir, "part").filter("p_size <= 25").select("p_partkey").distinct()
    one, two = known.withColumnRenamed("p_partkey", "k1"), known.withColumnRenamed("p_partkey", "k2")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    met = lines.join(one, lines.l_partkey == one.k1, "left").join(two, lines.l_suppkey == two.k2, "left")
    found = met.groupBy(F.col("l_orderkey").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k1").isNotNull() | F.col("k2").isNotNull()).alias("found"))
    return found.withColumn("percent", F.round(F.col("found") / F.col("n") * 100, 4))


@query("integrity_outer", "WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1) SELECT coalesce(o_orderkey, k) AS key, CASE WHEN k IS NULL THEN 'missing_file' WHEN o_orderkey IS NULL THEN 'orphaned_file' WHEN n > 6 THEN 'filesize_mismatch' ELSE 'ok' END AS kind FROM orders FULL OUTER JOIN l ON o_orderkey = k")
def integrity_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    kind = F.when(F.col("k").isNull(), "missing_file").when(F.col("o_orderkey").isNull(), "orphaned_file").when(F.col("n") > 6, "filesize_mismatch").otherwise("ok")
    return orders.join(lines, orders.o_orderkey == lines.k, "full_outer").select(F.coalesce("o_orderkey", "k").alias("key"), kind.alias("kind"))


@query("verification_counts", "SELECT o_orderstatus AS kind, o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2")
def verification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(lines, "o_orderkey", "left_anti").groupBy(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("shared_blocks", "SELECT l_partkey AS block, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def shared_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("block")).agg(F.count_distinct("l_orderkey").alias("n")).filter("n > 1")


@query("carry_over", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal > 5000 THEN 0 ELSE c_acctbal END, 0), s_acctbal) AS size, s_name IS NOT NULL AS known FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values replace old ones by key unless they are empty."""
    new = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, 0).otherwise(F.col("c_acctbal")).alias("v"))
    old = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_name")
    both = new.join(old, new.c_custkey == old.s_suppkey, "left")
    return both.select("c_custkey", F.coalesce(F.nullif("v", F.lit(0.0)), "s_acctbal").alias("size"), F.col("s_name").isNotNull().alias("known"))


_LABEL = "CASE l_linenumber % 5 WHEN 0 THEN l_quantity::INT || 'x' WHEN 1 THEN '00' || l_quantity::INT WHEN 2 THEN l_partkey || '' WHEN 3 THEN 'Page ' || l_quantity::INT ELSE '1:1' END"


@query("text_extract", rf"""WITH t AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS part, {_LABEL} AS label FROM lineitem)
SELECT page, n, part, label, coalesce(nullif(regexp_extract(label, '^0*(\d{{1,3}})$', 1), ''), nullif(regexp_extract(label, '^(?i:page|p\.?)\s*0*(\d{{1,3}})$', 1), ''))::INT AS page_no, nullif(regexp_extract(label, '^([1-9]\d{{0,3}})$', 1), '')::INT AS step,
nullif(regexp_extract(label, '^(\d{{1,3}})\s*[xX×]$', 1), '')::INT AS parts, nullif(regexp_extract(label, '^([1-9]\d?)$', 1), '')::INT AS bag, nullif(regexp_extract(label, '^([1-9]\d{{3,7}})$', 1), '') AS element, regexp_matches(label, '^1\s*:\s*1$') AS is_scale FROM t""")
def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    label = F.when(n % 5 == 0, F.concat(q, F.lit("x"))).when(n % 5 == 1, F.concat(F.lit("00"), q)).when(n % 5 == 2, F.col("l_partkey").cast("string")).when(n % 5 == 3, F.concat(F.lit("Page "), q)).otherwise("1:1")
    t = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("n"), F.col("l_partkey").alias("part"), label.alias("label"))
    c = F.col("label")
    return t.select("page", "n", "part", "label", tx.page_number(c).alias("page_no"), tx.step_number(c).alias("step"), tx.part_count(c).alias("parts"), tx.bag_number(c).alias("bag"), tx.element_id(c).alias("element"), tx.is_scale(c).alias("is_scale"))


@query("url_parts", "SELECT page_id, nullif(url_decode(regexp_extract(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1)), '') AS file, replace(url, '#', '%23') AS safe FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", tx.url_file_name(F.col("url")).alias("file"), tx.hash_encoded(F.col("url")).alias("safe"))


@query("html_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages), d AS (SELECT page_id, link, min(i) AS i FROM l GROUP BY 1, 2)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place FROM d""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(tx.links(F.col("html"))).alias("place", "link")).select("page_id", "link", F.col("place").cast("long").alias("place"))


@query("round_json", "SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS part, round_even(l_extendedprice / 7, 2) AS price FROM lineitem")
def round_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.bround(F.col("l_extendedprice") / 7, 2).alias("price"))


@query("nested_manual", "SELECT o_custkey AS manual, count(*) AS n_pages, sum(n)::BIGINT AS n_parts, min(o_orderkey) AS first_page FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def nested_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines nested in pages, pages in manuals, then read back by higher-order functions."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("parts"))
    pages = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    manuals = pages.groupBy(F.col("o_custkey").alias("manual")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "parts"))).alias("pages"))
    n_parts = F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + F.size(p["parts"]))
    return manuals.select("manual", F.size("pages").cast("long").alias("n_pages"), n_parts.alias("n_parts"), F.get("pages", F.lit(0))["o_orderkey"].alias("first_page"))


@query("golden_diff", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1 EXCEPT ALL SELECT r_regionkey, 4 FROM region")
def golden_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return actual.exceptAll(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.lit(4).cast("long").alias("n")))


@query("best_per_label", "SELECT lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 10")
def best_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return docs.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).filter("r <= 10").drop("r")



_ISSUE_EVENTS = "e AS (SELECT user_id AS doc, event_id AS seq, ts, CAST(floor(value) AS INT) % 40 AS number, event_type FROM events)"
_FIRST = f"WITH {_ISSUE_EVENTS}, f AS (SELECT doc, min(number) FILTER (event_type <> 'error') AS least, arg_min(number, (ts, seq)) FILTER (event_type <> 'error') AS first_seen, count(*) AS total, count(*) FILTER (event_type = 'error') AS missing FROM e GROUP BY doc)"


@query(
    "sequence_issues",
    f"""{_FIRST} SELECT doc, 'no_page_numbers' AS rule, 'error' AS severity, NULL::INT AS number FROM f WHERE first_seen IS NULL
 UNION ALL SELECT doc, 'high_first_page', 'warning', first_seen FROM f WHERE first_seen > 10
 UNION ALL SELECT doc, 'step_start', 'info', least FROM f WHERE least <> 1
 UNION ALL SELECT doc, 'missing_page_numbers', CASE WHEN (total - missing) / total * 100 < 50 THEN 'error' WHEN (total - missing) / total * 100 < 90 THEN 'warning' ELSE 'info' END, missing::INT FROM f WHERE missing > 0""",
)
def sequence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of numbered documents: none found, a high first number, a start other than 1, numbers missing by tier."""
    seen = F.when(F.col("event_type") != "error", F.floor("value").cast("int") % 40)
    order = F.when(seen.isNotNull(), F.struct("ts", "event_id"))
    found = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc")).agg(F.min(seen).alias("least"), F.min_by(seen, order).alias("first"), F.count(F.lit(1)).alias("total"), F.count_if(seen.isNull()).alias("missing"))
    share = (F.col("total") - F.col("missing")) / F.col("total") * 100
    tier = F.when(share < 50, "error").when(share < 90, "warning").otherwise("info")
    issue = lambda when, rule, severity, number: F.when(when, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), number.cast("int").alias("number")))
    first, least, missing = F.col("first"), F.col("least"), F.col("missing")
    issues = F.array_compact(
        F.array(
            issue(first.isNull(), "no_page_numbers", F.lit("error"), F.lit(None)),
            issue(first > 10, "high_first_page", F.lit("warning"), first),
            issue(least != 1, "step_start", F.lit("info"), least),
            issue(missing > 0, "missing_page_numbers", tier, missing),
        )
    )
    return found.select("doc", F.explode(issues).alias("i")).select("doc", "i.rule", "i.severity", "i.number")


@query("severity_counts", f"WITH i AS ({_FIRST} SELECT 'error' AS severity FROM f WHERE first_seen IS NULL UNION ALL SELECT 'warning' FROM f WHERE first_seen > 10 UNION ALL SELECT 'info' FROM f WHERE least <> 1 UNION ALL SELECT CASE WHEN (total - missing) / total * 100 < 50 THEN 'error' WHEN (total - missing) / total * 100 < 90 THEN 'warning' ELSE 'info' END FROM f WHERE missing > 0) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM i")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("severity")
    return sequence_issues(spark, sf_dir).agg(F.count_if(kind == "error").alias("errors"), F.count_if(kind == "warning").alias("warnings"), F.count_if(kind == "info").alias("infos"))


_RANGE = "CASE l_linenumber % 8 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 1 THEN ' 5 - ' || CAST(CAST(l_quantity AS INT) AS STRING) WHEN 2 THEN '10-' WHEN 3 THEN '-5' WHEN 4 THEN '-' WHEN 5 THEN 'x-3' WHEN 6 THEN '0' ELSE '' END"


@query(
    "page_ranges",
    rf"""WITH t AS (SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, trim({_RANGE}) AS r FROM lineitem), u AS (SELECT *, contains(r, '-') AS span, trim(split_part(r, '-', 1)) AS a, trim(r[strpos(r, '-') + 1:]) AS z FROM t),
 v AS (SELECT page, line, part, span, r, a, z, try_cast(CASE WHEN span THEN a ELSE r END AS INT) AS s, try_cast(CASE WHEN span THEN z ELSE r END AS INT) AS e FROM u)
SELECT page, line, part, CASE WHEN ok THEN s END AS first_page, CASE WHEN ok THEN e END AS last_page, ok FROM (SELECT *, CASE WHEN r = '' THEN false WHEN NOT span THEN coalesce(s >= 1, false) WHEN a = '' AND z = '' THEN false WHEN a = '' THEN coalesce(e >= 1, false) WHEN z = '' THEN coalesce(s >= 1, false) ELSE coalesce(s >= 1 AND e >= 1 AND s <= e, false) END AS ok FROM v)""",
)
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS line", "l_partkey AS part", f"{_RANGE} AS r")
    found = tx.page_range(F.col("r"))
    return lines.select("page", "line", "part", found["start"].alias("first_page"), found["end"].alias("last_page"), found["error"].isNull().alias("ok"))
