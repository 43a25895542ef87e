"""Mixing sources to target weights (operator 2, DataFrame functions only).

A token budget flows down a tree of domains, languages and sources.  At every
node the children share the budget by weight; a child that cannot use its share
(its subtree holds too few tokens, even over ``max_epochs`` passes) gets what it
holds, and the shortage goes to its siblings.  Only when all siblings are full
does a shortage reach the ancestors, because a node never asks for more than
its subtree holds.  Each leaf then takes whole seeded epochs and, of the last
one, the prefix of a seeded order that fills its budget; the document at the
boundary gives its first words only.

No document is ordered that needs no order: per leaf, sums over hash buckets
locate the one bucket that holds the boundary, and only that bucket is sorted.
All amounts are integers; a fraction of a token is dropped at each node.

Defined results: null or empty texts have no tokens; null levels are nodes of
their own; rows that repeat a doc_id stand together in the order and share the
cut; an empty table gives an empty result; weight 0 excludes a node; names
missing from the weights have weight 1; extra columns are passed through by
:func:`mix_documents`, and under any name by :func:`filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.llm.common import WORD, aside, cut, small, table, words_column

SEED = "mix-1"
MAX_EPOCHS = 2
#: Of all tokens of the input, the share that the mixture holds.
BUDGET_PERCENT = 80
DOMAINS = 3
LEVELS = ("m__domain", "m__lang", "m__source")
BUCKET_DIGITS = 3  # hash buckets of a leaf: 16 ** 3


@dataclass(frozen=True)
class Weights:
    """Integer weights of nodes by name, one table for each level."""

    domain: dict[str, int] = field(default_factory=lambda: {"d0": 3, "d1": 2, "d2": 2})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    source: dict[str, int] = field(default_factory=dict)

    def levels(self) -> tuple[dict[str, int], ...]:
        return self.domain, self.lang, self.source


def domain_of(source: Column) -> Column:
    """The table has no domain: sources are dealt to ``DOMAINS`` by their name's MD5."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 4), 16, 10).cast("int") % DOMAINS).cast("string"))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("decimal(38,0)")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``alloc``: the share of ``budget`` (of the parent) of each child.

    ``nodes`` has the parent's columns, ``name``, ``w``, ``cap`` and ``budget``.
    Children are taken by rising cap per weight; the full ones are a prefix.
    """
    before = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    among = Window.partitionBy(*parent)
    zero = F.lit(0).cast("decimal(38,0)")
    df = nodes.withColumn("m__spent", F.coalesce(F.sum("cap").over(before), zero)).withColumn("m__left", F.sum("w").over(among) - F.coalesce(F.sum("w").over(before), zero))
    df = df.withColumn("m__full", F.col("cap") * F.col("m__left") <= (F.col("budget") - F.col("m__spent")) * F.col("w"))
    df = df.withColumn("m__held", F.sum(F.when(F.col("m__full"), F.col("cap")).otherwise(zero)).over(among)).withColumn("m__rest", F.sum(F.when(F.col("m__full"), zero).otherwise(F.col("w"))).over(among))
    share = F.expr("((budget - m__held) * w) div m__rest").cast("decimal(38,0)")
    return df.withColumn("alloc", F.when(F.col("m__full"), F.col("cap")).otherwise(share)).drop("m__spent", "m__left", "m__full", "m__held", "m__rest")


def plan(leaves: DataFrame, weights: Weights, max_epochs: int, percent: int) -> DataFrame:
    """Per leaf: tokens, alloc, whole epochs and the tokens of the last one.

    ``leaves`` has the three level columns and ``tokens``.
    """
    by_level = weights.levels()
    usable = F.lit(True)
    for column, table_ in zip(LEVELS, by_level, strict=True):
        usable = usable & (_weight(F.col(column), table_) > 0)
    capped = leaves.withColumn("cap", F.when(usable, F.col("tokens") * max_epochs).otherwise(0).cast("decimal(38,0)"))
    above = None
    for depth, column in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        parent = keys[:-1]
        nodes = capped.groupBy(*keys).agg(F.sum("cap").cast("decimal(38,0)").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("w", F.greatest(_weight(F.col(column), by_level[depth]), F.lit(1).cast("decimal(38,0)")))
        if above is None:
            total = capped.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * percent / 100).cast("long")).first()[0]
            nodes = nodes.withColumn("budget", F.lit(total).cast("decimal(38,0)"))
        else:
            renamed = above.select(*(F.col(c).alias(f"{c}_up") for c in parent), F.col("alloc").alias("budget"))
            on = [F.col(c).eqNullSafe(F.col(f"{c}_up")) for c in parent]
            nodes = nodes.join(renamed, on).drop(*(f"{c}_up" for c in parent))
        # the tree has a row for each node, far fewer than documents
        above = cut(fill(nodes, parent, column), f"mix-level{depth}")
    whole = F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(0).cast("long")
    out = above.select(*LEVELS, F.col("tokens").cast("long"), F.col("alloc").cast("long"), whole.alias("whole"))
    return out.withColumn("rest", F.col("alloc") - F.col("whole") * F.col("tokens"))


def _order(epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _on_leaf(right: DataFrame) -> list[Column]:
    return [F.col(c).eqNullSafe(right[f"{c}_r"]) for c in LEVELS]


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_r" for c in LEVELS})


def _with_levels(docs: DataFrame) -> DataFrame:
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.withColumns({LEVELS[0]: domain_of(F.col("source")), LEVELS[1]: F.col("lang"), LEVELS[2]: F.col("source"), "m__tokens": tokens})


def mix_documents(docs: DataFrame, weights: Weights | None = None, seed: str = SEED, max_epochs: int = MAX_EPOCHS, percent: int = BUDGET_PERCENT) -> DataFrame:
    """The chosen documents, a row for each epoch that takes one.

    Adds to the input's columns: the levels, ``m__tokens``, ``m__epoch`` and
    ``m__take`` (how many of its words this epoch takes).
    """
    weights = weights or Weights()
    wide = _with_levels(docs)
    slim = cut(wide.select(*LEVELS, "doc_id", "m__tokens"), "mix-slim")
    leaves = cut(slim.groupBy(*LEVELS).agg(F.sum("m__tokens").alias("tokens")), "mix-leaves")
    leaf_plan = cut(plan(leaves, weights, max_epochs, percent), "mix-plan")

    # Where the prefix of the last epoch ends, one row for each leaf at most.
    partial = small(_renamed(leaf_plan.filter("rest > 0").select(*LEVELS, "whole", "rest")))
    placed = slim.join(partial, _on_leaf(partial)).drop(*(f"{c}_r" for c in LEVELS)).withColumn("m__h", _order(F.col("whole"), seed))
    placed = placed.withColumn("m__bucket", F.substring("m__h", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*LEVELS, "m__bucket").agg(F.sum("m__tokens").alias("n"), F.first("rest").alias("rest"))
    so_far = Window.partitionBy(*LEVELS).orderBy("m__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("m__start", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    bound = cut(sums.filter((F.col("m__start") <= F.col("rest")) & (F.col("rest") < F.col("m__start") + F.col("n"))).select(*LEVELS, F.col("m__bucket").alias("m__edge"), "m__start"), "mix-bound")
    bound = small(_renamed(bound))
    inside = placed.join(bound, [*_on_leaf(bound), F.col("m__bucket") == F.col("m__edge")]).drop(*(f"{c}_r" for c in LEVELS))
    ties = inside.groupBy(*LEVELS, "m__h", "doc_id").agg(F.sum("m__tokens").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("rest").alias("rest"), F.first("m__start").alias("m__start"))
    within = Window.partitionBy(*LEVELS).orderBy("m__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("m__at", F.col("m__start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    at_edge = ties.filter((F.col("m__at") <= F.col("rest")) & (F.col("rest") < F.col("m__at") + F.col("n")))
    edge = at_edge.select(*LEVELS, F.col("m__h").alias("e__h"), F.col("doc_id").alias("e__id"), F.expr("(rest - m__at) div copies").alias("e__take"))
    whole_plan = leaf_plan.filter("alloc > 0").select(*LEVELS, "whole", "rest")
    edge = _renamed(edge)
    final = whole_plan.join(edge, _on_leaf(edge), "left").drop(*(f"{c}_r" for c in LEVELS))
    final = small(_renamed(cut(final.withColumnsRenamed({"whole": "e__whole", "rest": "e__rest"}), "mix-final")))

    chosen = wide.join(final, _on_leaf(final)).drop(*(f"{c}_r" for c in LEVELS))
    tokens = F.col("m__tokens")
    h = _order(F.col("e__whole"), seed)
    same = F.col("doc_id").eqNullSafe(F.col("e__id"))
    # nulls stand first among equal hashes, which only rows of one doc_id have
    last = F.when(F.col("e__rest") <= 0, None).when(h < F.col("e__h"), tokens).when((h == F.col("e__h")) & same, F.least(F.col("e__take"), tokens))
    take = lambda e, n: F.struct(e.cast("long").alias("epoch"), n.cast("long").alias("take"))
    whole = F.when(F.col("e__whole") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("e__whole") - 1), lambda e: take(e, tokens))).otherwise(F.array().cast("array<struct<epoch:bigint,take:bigint>>"))
    part = F.when((h < F.col("e__h")) | (last > 0), F.array(take(F.col("e__whole"), last))).otherwise(F.array().cast("array<struct<epoch:bigint,take:bigint>>"))
    chosen = chosen.withColumn("m__x", F.explode(F.concat(whole, F.coalesce(part, F.array().cast("array<struct<epoch:bigint,take:bigint>>")))))
    return chosen.withColumns({"m__epoch": F.col("m__x.epoch"), "m__take": F.col("m__x.take")}).drop("m__x", "e__h", "e__id", "e__take", "e__whole", "e__rest")


def shortened(text: Column, tokens: Column, take: Column) -> Column:
    """The whole text, or its first ``take`` words joined by single spaces."""
    return F.when(take < tokens, F.array_join(F.slice(words_column(text), 1, take.cast("int")), " ")).otherwise(text)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the input's columns; a cut text has its first words."""
    given, docs = docs.columns, aside(docs, "doc_id text lang source n_chars")
    out = mix_documents(docs, **options)
    text = shortened(F.col("text"), F.col("m__tokens"), F.col("m__take"))
    out = out.withColumn("text", text)
    if "n_chars" in given:
        out = out.withColumn("n_chars", F.when(F.col("m__take") < F.col("m__tokens"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns).toDF(*given)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col(LEVELS[0]).alias("domain"), "lang", "source", F.col("m__epoch").alias("epoch"), F.col("m__tokens").alias("n_tokens"), F.col("m__take").alias("take"))


def _case(name: str, weights: dict[str, int]) -> str:
    return f"(CASE {' '.join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END)::HUGEINT" if weights else "1::HUGEINT"


def oracle_ctes(docs: str) -> str:
    """CTEs that end in ``m_rows``: the columns of ``docs`` and domain, tokens, epoch, take."""
    out = [
        f"m_docs AS (SELECT doc_id, lang, source, 'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 4))::INT % {DOMAINS}) AS domain, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM {docs})",
        f"m_cap AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {MAX_EPOCHS} AS cap FROM m_docs GROUP BY ALL)",
        f"m_up0 AS (SELECT (sum(tokens) * {BUDGET_PERCENT} / 100)::DOUBLE AS b FROM m_cap)",
        f"m_n1 AS (SELECT domain, sum(cap)::HUGEINT AS cap, {_case('domain', Weights().domain)} AS w, (SELECT floor(b)::HUGEINT FROM m_up0) AS budget FROM m_cap GROUP BY domain)",
    ]
    keys = ["domain", "lang", "source"]
    for i, weights in enumerate(Weights().levels(), 1):
        parent = ", ".join(keys[: i - 1])
        part = f"PARTITION BY {parent}" if parent else ""
        out.append(
            f"m_s{i} AS (SELECT *, cap * (sum(w) OVER ({part}) - coalesce(sum(w) OVER b, 0)) <= (budget - coalesce(sum(cap) OVER b, 0)) * w AS is_full FROM m_n{i} "
            f"WINDOW b AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {keys[i - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
        )
        out.append(
            f"m_a{i} AS (SELECT *, CASE WHEN is_full THEN cap ELSE ((budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})) * w)::HUGEINT // (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}))::HUGEINT END AS alloc FROM m_s{i})"
        )
        if i < 3:
            cols = ", ".join(f"c.{k}" for k in keys[: i + 1])
            on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM a.{k}" for k in keys[:i])
            out.append(f"m_n{i + 1} AS (SELECT {cols}, sum(c.cap)::HUGEINT AS cap, {_case(f'c.{keys[i]}', Weights().levels()[i])} AS w, any_value(a.alloc) AS budget FROM m_cap c JOIN m_a{i} a ON {on} GROUP BY ALL)")
    same = " AND ".join(f"d.{k} IS NOT DISTINCT FROM a.{k}" for k in keys)
    out += [
        f"m_plan AS (SELECT d.domain, d.lang, d.source, d.tokens, CASE WHEN d.tokens > 0 THEN alloc // d.tokens ELSE 0 END AS n_whole, alloc FROM m_cap d JOIN m_a3 a ON {same})",
        f"m_placed AS (SELECT d.*, a.n_whole, a.alloc - a.n_whole * a.tokens AS rest, md5('{SEED}|' || a.n_whole || '|' || coalesce(d.doc_id::VARCHAR, 'null')) AS h FROM m_docs d JOIN m_plan a ON {same} WHERE alloc > 0)",
        "m_at AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM m_placed)",
        "m_part AS (SELECT *, n_whole AS epoch, least(n_tokens, rest - offs) AS take FROM m_at WHERE rest > offs)",
        "m_whole AS (SELECT *, unnest(range(0, n_whole::BIGINT)) AS epoch, n_tokens AS take FROM m_at)",
        "m_rows AS (SELECT * FROM m_part UNION ALL BY NAME SELECT * FROM m_whole)",
    ]
    return ",\n".join(out)


ORACLE = f"WITH {oracle_ctes('documents')} SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens, take::BIGINT AS take FROM m_rows"
__all__ = ["ORACLE", "Weights", "fill", "filter_documents", "mix_documents", "oracle_ctes", "plan", "query"]
