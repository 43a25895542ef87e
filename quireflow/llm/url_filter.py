"""URL filter (operator 6, DataFrame and SQL functions only).

Rules decide first: a rule names a host and the start of a path, fits the host
and all its subdomains, and the longest fitting rule wins.  Every other URL is
judged by a logistic regression on hashed character n-grams of host and path,
trained by gradient descent inside one SQL expression on a small labelled table.

Defined results: a null URL, or one without ``://``, has an empty host and path
and goes to the model; an empty table gives an empty result; repeated rows are
judged alike; extra columns are ignored.  The labelled table is a parameter and
must hold at most ``MAX_LABELLED`` rows.
"""

from __future__ import annotations

import hashlib
import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import cut, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SIZES = (3, 4)
BUCKETS = 512
STEPS = 60
RATE = 4.0
RIDGE = 1e-4
MAX_LABELLED = 5_000


def labelled_urls() -> list[tuple[str, int]]:
    """A small labelled table, made by a rule: 1 marks URLs to block."""
    topics = ("article", "notes", "guide", "history", "library", "science")
    traps = ("casino-bonus", "free-pills", "click-win", "xxx-cams", "adtrack", "cheap-replica")
    langs = ("en", "de", "fr", "es")
    good = [(f"https://{t}.example.{d}/{g}/{100 * i + 7 * j}", 0) for i, t in enumerate(topics) for j, (g, d) in enumerate(zip(langs, ("com", "org", "net", "com"), strict=True))]
    good += [(f"http://blog.{t}.example.org/{g}/{t}-{31 * i + 3 * j}.html", 0) for i, t in enumerate(topics) for j, g in enumerate(langs)]
    bad = [(f"http://{t}.example.{d}/{t}/{g}/{j + 1}", 1) for t in traps for j, (g, d) in enumerate(zip(langs, ("net", "com", "org", "net"), strict=True))]
    bad += [(f"https://www.{t}{i}.example.com/win/{t}.php", 1) for t in traps for i in range(4)]
    return good + bad


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        where, _, start = rule.partition("/")
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, sizes=SIZES, buckets: int = BUCKETS) -> Column:
    """Bucket numbers (from 0) of the character n-grams of ``^host path$``."""
    marked = F.concat(F.lit("^"), host, path, F.lit("$"))

    def of(n: int) -> Column:
        return F.when(
            F.length(marked) >= n,
            F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.conv(F.substring(F.md5(F.substring(marked, i, F.lit(n))), 1, 4), 16, 10).cast("int") % buckets),
        ).otherwise(F.array().cast("array<int>"))

    return F.concat(*(of(n) for n in sizes))


def train(labelled: DataFrame, sizes=SIZES, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> list[float]:
    """Weights of the buckets, then the intercept, by full-batch gradient descent.

    ``labelled`` has ``url`` and ``label`` (1: block).  The descent runs as one
    SQL expression over arrays; only ``buckets + 1`` numbers reach the driver.
    """
    if labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"the labelled table must hold at most {MAX_LABELLED} rows")
    host, path = split_url(F.col("url"))
    rows = labelled.filter("url IS NOT NULL AND label IS NOT NULL").select(F.col("url"), F.col("label").cast("double").alias("y"), grams(host, path, sizes, buckets).alias("g"))
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "g"))).alias("r"))
    packed = packed.selectExpr("size(r) AS n", "transform(r, x -> x.y) AS y", "transform(r, x -> transform(x.g, j -> struct(j AS j, 1 / sqrt(size(x.g)) AS v))) AS x")
    # each table is stored: Spark would else put the arrays' definitions into the loops that read them
    entries = cut(packed, "url-rows").selectExpr("*", "flatten(transform(x, (e, i) -> transform(e, k -> struct(k.j AS j, i AS i, k.v AS v)))) AS e")
    spread = cut(entries, "url-entries").selectExpr("n", "y", "x", f"transform(sequence(0, {buckets - 1}), b -> filter(e, k -> k.j = b)) AS p")
    errors = f"transform(x, (r, i) -> 1 / (1 + exp(-aggregate(r, w[{buckets}], (a, k) -> a + w[k.j] * k.v))) - y[i])"
    moved = f"transform(slice(w, 1, {buckets}), (c, j) -> c - {rate!r}D * (aggregate(p[j], 0D, (a, k) -> a + g[k.i] * k.v) / n + {ridge!r}D * c))"
    shift = f"array(w[{buckets}] - {rate!r}D * aggregate(g, 0D, (a, k) -> a + k) / n)"
    step = f"transform(array({errors}), g -> concat({moved}, {shift}))[0]"
    fitted = cut(spread, "url-postings").filter("n > 0").selectExpr(f"aggregate(sequence(1, {steps}), array_repeat(0D, {buckets + 1}), (w, t) -> {step}) AS w").first()
    return list(fitted["w"]) if fitted else [0.0] * (buckets + 1)


def score(host: Column, path: Column, weights: list[float], sizes=SIZES) -> Column:
    """Log-odds that the URL is to be blocked."""
    buckets = len(weights) - 1
    held = F.array(*(F.lit(float(x)) for x in weights[:-1]))
    found = grams(host, path, sizes, buckets)
    return F.lit(float(weights[-1])) + F.aggregate(found, F.lit(0.0), lambda a, j: a + F.get(held, j)) / F.greatest(F.sqrt(F.size(found)), F.lit(1.0))


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every URL."""
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(score(F.col("host"), F.col("path"), weights) > 0, "block").otherwise("allow")
    return df.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def labelled_frame(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{u}', {y})" for u, y in labelled_urls())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), train(labelled_frame(spark)))


def _plain_weights() -> list[float]:
    """The same descent in plain Python, for the oracle and the tests."""
    rows = []
    for url, y in sorted(labelled_urls()):
        rest = url.partition("://")[2]
        s = f"^{rest.lower()}$"
        found = [int(hashlib.md5(s[i : i + n].encode()).hexdigest()[:4], 16) % BUCKETS for n in SIZES for i in range(len(s) - n + 1)]
        rows.append((found, 1 / math.sqrt(len(found)), float(y)))
    w = [0.0] * (BUCKETS + 1)
    for _ in range(STEPS):
        slope = [0.0] * (BUCKETS + 1)
        for found, v, y in rows:
            z = w[BUCKETS]
            for j in found:
                z += w[j] * v
            g = 1 / (1 + math.exp(-z)) - y
            slope[BUCKETS] += g
            for j in found:
                slope[j] += g * v
        w = [c - RATE * (s / len(rows) + RIDGE * c * (j < BUCKETS)) for j, (c, s) in enumerate(zip(w, slope, strict=True))]
    return w


def oracle() -> str:
    w = _plain_weights()
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{kind} {h}/{p}'" for kind, h, p in ((k, *r.split("/", 1)) for k, r in sorted(RULES, key=lambda r: -len(r[1])))
    )
    parts = " || ".join(f"[('0x' || substr(md5(substr(s, i, {n})), 1, 4))::INT % {BUCKETS} FOR i IN range(1, length(s) - {n} + 2)]" for n in SIZES)
    return f"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '^' || host || path || '$' AS s, CASE {fits} END AS hit FROM b),
d AS (SELECT *, {parts} AS g FROM c),
e AS (SELECT *, {w[-1]!r}::DOUBLE + list_sum([({[float(x) for x in w[:-1]]})[j + 1] FOR j IN g]) / greatest(sqrt(len(g)), 1) AS z FROM d)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1) WHEN z > 0 THEN 'block' ELSE 'allow' END AS verdict FROM e"""
