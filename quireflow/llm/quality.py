"""Quality rules with a host-level verdict (operator 5, DataFrame functions only).

Every document gets four counts and a base verdict.  Failures are aggregated by
host (``source``), each host's failure rate is shrunk towards the corpus rate by
a beta prior whose two parameters are fitted to the spread of the host rates
beyond what drawing each host's documents explains, and hosts whose shrunk rate exceeds ``max_rate`` lose all their documents.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows each count; an empty table gives an empty result;
extra columns, whatever their names, are ignored (or passed through by
:func:`filter_documents`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import SPACE, aside, cut, small, table, words_column

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 1000.0)
SYMBOLS = r"[#*$%&|<>]"


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside 3-word windows that occur at least twice.

    The window hashes of one text are sorted together with their positions, so
    the work is n log n in the words of that text, whatever repeats in it.
    """
    w, h, s, d = F.col(words), f"{out}__h", f"{out}__s", f"{out}__d"
    df = df.withColumn(
        h,
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    hashes = F.col(h)
    df = df.withColumn(
        s,
        F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )
    ordered = F.col(s)
    twin = lambda x, j: x["h"].eqNullSafe(F.get(ordered, j - 1)["h"]) | x["h"].eqNullSafe(F.get(ordered, j + 1)["h"])
    df = df.withColumn(d, F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"])))
    starts = F.col(d)
    covered = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3))))
    return df.withColumn(out, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop(h, s, d)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` plus the five counts and ``base_failed`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, words_column(F.col("text")).alias("q__w"), (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("q__l"))
    df = with_repeats(df, "q__w", "n_repeat_words")
    w, kept_lines = F.col("q__w"), F.col("q__l")
    df = df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(kept_lines) - F.size(F.array_distinct(kept_lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return df.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def rejected_hosts(flags: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts whose shrunk failure rate exceeds ``max_rate`` (column ``q__host``).

    ``flags`` has the host and ``base_failed``.  The prior is one row of sums
    over hosts, the only thing that reaches the driver.  Its weight ``s`` solves the
    beta-binomial variance of the rates, ``m (1 - m) (a + (1 - a) / (s + 1))``, where
    ``a`` is the mean of 1 / n; where nothing is left to explain it is the largest.
    """
    hosts = cut(flags.groupBy(F.col(host).alias("q__host")).agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("f")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f")).first()
    mean = (total["f"] or 0) / (total["n"] or 1)
    found = hosts.agg(F.avg(F.pow(F.col("f") / F.col("n") - F.lit(mean), F.lit(2.0))).alias("v"), F.avg(F.lit(1.0) / F.col("n")).alias("a")).first()
    drawn = mean * (1 - mean)
    beyond = (found["v"] or 0.0) - drawn * (found["a"] or 0.0)
    weight = min(max(drawn * (1 - found["a"]) / beyond - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if beyond > 0 else PRIOR_WEIGHT[1]
    shrunk = (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.filter(shrunk > max_rate).select("q__host")


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: doc_id, the counts, ``base_failed`` and ``kept``."""
    found = cut(measures(docs, "doc_id", "source"), "quality").withColumnRenamed("source", "q__source")
    bad = rejected_hosts(found, "q__source", max_rate).withColumn("q__bad", F.lit(True))
    joined = found.join(small(bad), F.col("q__source").eqNullSafe(F.col("q__host")), "left")
    kept = ~F.col("base_failed") & F.col("q__bad").isNull()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def filter_documents(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with all their columns."""
    given, docs = docs.columns, aside(docs, "text source")

    def flagged(df: DataFrame) -> DataFrame:
        wide = with_repeats(df.withColumn("q__w", words_column(F.col("text"))), "q__w", "q__r")
        return wide.withColumn("base_failed_q", base_failed(F.size("q__w"), F.col("q__r")))

    flags = cut(flagged(docs.select("source", "text")).select("source", F.col("base_failed_q").alias("base_failed")), "flags")
    bad = small(rejected_hosts(flags, "source", max_rate))
    # a numbered row keeps Spark from moving the filter, and with it the arrays' definitions, into the loops that read them
    numbered = flagged(docs).withColumn("q__row", F.monotonically_increasing_id())
    passed = numbered.filter(~F.col("base_failed_q") & (F.col("q__row") >= 0)).select(*docs.columns)
    return passed.join(bad, passed["source"].eqNullSafe(bad["q__host"]), "left_anti").toDF(*given)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_LEAST, _MOST = PRIOR_WEIGHT
#: Counts and base verdict of the rows of {docs}, then the host verdict.
ORACLE_TEMPLATE = rf"""
q_rows AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM {{docs}}),
q_words AS (SELECT rid, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(text, '') AS t FROM q_rows),
q_tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM q_words, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
q_twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM q_tri) WHERE n > 1),
q_cover AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM q_twice, (VALUES (0), (1), (2)) AS v(d) GROUP BY rid),
q_measures AS (SELECT r.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_rows r JOIN q_words USING (rid) LEFT JOIN q_cover USING (rid)),
q_base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q_measures),
q_hosts AS (SELECT source AS host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM q_base GROUP BY 1),
q_mean AS (SELECT sum(f) / sum(n) AS m FROM q_hosts),
q_spread AS (SELECT m, avg(pow(f / n - m, 2)) AS v, avg(1.0::DOUBLE / n) AS a FROM q_hosts, q_mean GROUP BY m),
q_prior AS (SELECT m, CASE WHEN v - m * (1 - m) * a > 0 THEN least(greatest(m * (1 - m) * (1 - a) / (v - m * (1 - m) * a) - 1, {_LEAST}), {_MOST}) ELSE {_MOST} END AS s FROM q_spread),
q_bad AS (SELECT host FROM q_hosts, q_prior WHERE (f + m * s) / (n + s) > {MAX_HOST_RATE}),
q_judged AS (SELECT b.*, NOT base_failed AND NOT EXISTS (SELECT 1 FROM q_bad WHERE host IS NOT DISTINCT FROM b.source) AS kept FROM q_base b)
"""

ORACLE = f"WITH {ORACLE_TEMPLATE.format(docs='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_judged"
