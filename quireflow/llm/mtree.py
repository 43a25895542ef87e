"""Exact top-k by inner product with paged metric trees (operator 1).

The vectors (components floored to integers) are dealt to metric cells by their
nearest of a few pivots, large cells are split into shards, and each shard is
bulk-loaded into an M-tree.  A page holds routing objects with covering radii and
the distances to their parent; leaves hold vectors with the same distance.  The
pages are rows, a search is a best-first walk over them.

The score is no metric, so bounds come from Euclidean distance: all v within r
of p have <q,v> <= <q,p> + |q| r.  With <q,parent> known, an entry at stored
distance d from its parent scores at most <q,parent> + |q| (d + r); entries whose
stored bound is below the k-th score so far are never compared with the query.
Bounds are floats with slack, scores are exact integers, so results are exact.

Queries are not sent to cells that cannot hold one of their k best; the k-th
score among a bounded sample (``SAMPLE`` rows) starts that test.

Defined results: null vectors, and vectors holding null, NaN or infinite
components take no part; shorter vectors count as padded with zeros; rows with a
query's own vec_id are not its candidates; a null vec_id takes no part; repeated
rows are candidates each, and a vec_id asked for repeatedly is one query (its
smallest vector); equal scores go to the smaller vec_id; fewer than k
candidates give fewer rows; empty tables give an empty result; extra columns are
ignored.  Scores must fit a 64-bit integer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.llm.common import cut, table

K = 10
SCALE = 1024
SAMPLE = 2048
PIVOTS = 32
SHARD_ROWS = 4096
PAGE = 64
FANOUT = 16
#: Pages that a long search opens at a time.
BATCH = 16
#: Relative slack of float bounds.
SLACK = 1e-9


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of long) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale))
    return df.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(~odd).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floats where these are exact too."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[-1], 1)
    if top < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _dist(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = a.astype(np.float64) - p.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def spread_pivots(v: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it."""
    if not len(v):
        return v
    chosen, near = [0], _dist(v, v[0])
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _dist(v, v[chosen[-1]]))
    return v[chosen]


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, p = v.astype(np.float64), pivots.astype(np.float64)
    squares = (f * f).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * f @ p.T
    at = squares.argmin(axis=1)
    return at, np.sqrt(((f - p[at]) ** 2).sum(1))


def build_pages(ids: np.ndarray, v: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> list[dict]:
    """Bulk-loads one M-tree; page 0 is the root.

    A page: leaf flag, pivot row numbers (routing objects or vectors' own rows),
    distance of each entry to the page's routing object, covering radii, child
    pages.  Routing objects are vectors of the set.
    """
    pages: list[dict] = []

    def load(rows: np.ndarray, pivot: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        if len(rows) <= page:
            pages[number] = {"leaf": True, "ids": ids[rows], "v": v[rows], "d": _dist(v[rows], pivot), "r": np.zeros(len(rows)), "child": np.zeros(0, np.int64)}
            return number
        heads = spread_pivots(v[rows], fanout)
        at, far = nearest(v[rows], heads)
        # copies of one vector, or a lopsided cell, are cut into even pieces
        groups = [rows[at == i] for i in range(len(heads))]
        if max(map(len, groups)) > 0.9 * len(rows):
            order = rows[np.argsort(far, kind="stable")]
            groups = np.array_split(order, min(fanout, math.ceil(len(rows) / page)))
            heads = np.stack([v[g[0]] for g in groups])
        kept = [i for i, g in enumerate(groups) if len(g)]
        pages[number] = {
            "leaf": False,
            "ids": np.zeros(0, np.int64),
            "v": heads[kept],
            "d": _dist(heads[kept], pivot),
            "r": np.array([_dist(v[groups[i]], heads[i]).max() for i in kept]),
            "child": np.array([load(groups[i], heads[i]) for i in kept], np.int64),
        }
        return number

    if len(ids):
        load(np.arange(len(ids)), v[0])
    return prepare([p | {"base": v[0]} for p in pages])


def prepare(pages: list[dict]) -> list[dict]:
    """Adds the arrays that a search reads: all entries of all pages end to end, held by page 0."""
    if pages:
        keep = {name: np.concatenate([p[name] for p in pages]) for name in ("v", "r")}
        at = np.concatenate([[0], np.cumsum([len(p["d"]) for p in pages])])
        label = np.concatenate([p["ids"] if p["leaf"] else p["child"] for p in pages])  # a vector's id, or a child page
        leaf = np.repeat([p["leaf"] for p in pages], np.diff(at))
        reach = np.concatenate([p["d"] + p["r"] for p in pages])
        pages[0]["all"] = keep | {"f": keep["v"].astype(np.float64), "top": float(np.abs(keep["v"]).max(initial=0)), "at": at, "label": label, "leaf": leaf, "reach": reach}
    return pages


def search(pages: list[dict], query_id: int, q: np.ndarray, k: int, least: float = -math.inf, counts: dict | None = None) -> list[tuple[int, int]]:
    """The k best (score, vec_id) among the pages' vectors, best first.

    The pages with the best bounds are opened one, two, four, ... up to ``BATCH``
    at a time, so that a long search works on long arrays and a short one opens
    few pages in vain.  ``least``: scores below it are of no use.  ``counts`` gets
    the number of vectors and routing objects compared.
    """
    if not pages:
        return []
    held = pages[0]["all"]
    f, top = q.astype(np.float64), float(np.abs(q).max(initial=0))
    exact_floats = top * held["top"] * max(len(q), 1) < 2**53
    length = math.sqrt(float(f @ f))
    best: list[tuple[int, int]] = []  # a heap of (score, -vec_id): the worst on top
    kth = least

    base = pages[0]["base"]  # the root's routing object
    queue = [(-math.inf, 0, float(_dot(q[None, :], base[None, :])[0, 0]))]
    turn = 1
    while queue:
        opened = []
        while queue and len(opened) < turn and -queue[0][0] >= kth:
            opened.append(heapq.heappop(queue))
        if not opened:
            break
        turn = min(2 * turn, BATCH)
        number = np.array([n for _, n, _ in opened])
        first, size = held["at"][number], held["at"][number + 1] - held["at"][number]
        rows = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        parent = np.repeat([s for _, _, s in opened], size)
        reach = length * held["reach"][rows]
        rows = rows[parent + reach + SLACK * (np.abs(parent) + reach + 1) >= kth]
        if not len(rows):
            continue
        scores = np.rint(held["f"][rows] @ f).astype(np.int64) if exact_floats else held["v"][rows] @ q
        if counts is not None:
            counts["compared"] = counts.get("compared", 0) + len(rows)
        leaf, label = held["leaf"][rows], held["label"][rows]
        good = np.flatnonzero(leaf & (scores >= kth))  # equal scores may still win by their vec_id
        for s, i in zip(scores[good].tolist(), label[good].tolist(), strict=True):
            if i == query_id:
                continue
            if len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))
        if len(best) == k:
            kth = max(kth, best[0][0])
        inner = np.flatnonzero(~leaf)
        if len(inner):
            reach = length * held["r"][rows[inner]]
            above = scores[inner] + reach + SLACK * (np.abs(scores[inner]) + reach + 1)
            for u, c, s in zip(above.tolist(), label[inner].tolist(), scores[inner].tolist(), strict=True):
                if u >= kth:
                    heapq.heappush(queue, (-u, c, float(s)))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


PAGE_SCHEMA = "shard long, page long, leaf boolean, n long, base binary, ids binary, v binary, d binary, r binary, child binary"


def _pack(shard: int, pages: list[dict], base: np.ndarray) -> pd.DataFrame:
    rows = [
        (shard, i, p["leaf"], len(p["d"]), base.tobytes(), p["ids"].tobytes(), p["v"].tobytes(), p["d"].tobytes(), p["r"].tobytes(), p["child"].tobytes()) for i, p in enumerate(pages)
    ]
    return pd.DataFrame(rows, columns=["shard", "page", "leaf", "n", "base", "ids", "v", "d", "r", "child"])


def unpack(pdf: pd.DataFrame, dim: int) -> list[dict]:
    pages = []
    for x in pdf.sort_values("page").itertuples():
        pages.append(
            {
                "leaf": bool(x.leaf),
                "base": np.frombuffer(x.base, np.int64),
                "ids": np.frombuffer(x.ids, np.int64),
                "v": np.frombuffer(x.v, np.int64).reshape(-1, dim) if dim else np.zeros((x.n, 0), np.int64),
                "d": np.frombuffer(x.d, np.float64),
                "r": np.frombuffer(x.r, np.float64),
                "child": np.frombuffer(x.child, np.int64),
            }
        )
    return prepare(pages)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score; both inputs as :func:`quantised` makes them."""
    spark = vectors.sparkSession
    held = cut(vectors, "mtree-vectors")
    total, dim = held.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = max(dim or 0, 0)
    sample = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded
    sample_ids, sample_v = np.array([r.vec_id for r in sample], np.int64), _matrix([r.v for r in sample], dim)
    n_shards = max(math.ceil(total / shard_rows), spark.sparkContext.defaultParallelism, 1)
    pivots = spread_pivots(sample_v, min(PIVOTS, n_shards))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, far = nearest(_matrix(pdf["v"], dim), pivots) if len(pdf) and len(pivots) else (np.zeros(0, int), np.zeros(0))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "cell": at, "far": far})

    dealt = cut(held.mapInPandas(deal, "vec_id long, v array<long>, cell long, far double"), "mtree-cells")
    # one row for each pivot: PIVOTS rows at most
    cells = {r.cell: (r.n, r.far) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    per_shard = max(1, math.ceil(total / n_shards))
    first, shards = 0, {}
    for cell, (n, _) in sorted(cells.items()):
        shards[cell] = (first, math.ceil(n / per_shard))
        first += shards[cell][1]
    start, salts = F.lit(0), F.lit(1)
    for cell, (a, n) in shards.items():
        start, salts = F.when(F.col("cell") == cell, a).otherwise(start), F.when(F.col("cell") == cell, n).otherwise(salts)
    sharded = dealt.withColumn("shard", (start + F.pmod(F.xxhash64("vec_id", "v"), salts)).cast("long"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"], dim)
        return _pack(int(pdf["shard"].iloc[0]), build_pages(ids, v), v[0])

    pages = sharded.select("shard", "vec_id", "v").groupBy("shard").applyInPandas(build, PAGE_SCHEMA)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The shards that may hold one of a query's best, with the k-th score of the sample."""
        for pdf in batches:
            out = []
            for at in range(0, len(pdf) if len(pivots) else 0, 256):
                part = pdf.iloc[at : at + 256]
                q = _matrix(part["v"], dim)
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                known, heads = _dot(q, sample_v), _dot(q, pivots)
                for i, query_id in enumerate(part["vec_id"].tolist()):
                    own = known[i][sample_ids != query_id]
                    least = int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else None
                    for cell, (a, n) in shards.items():
                        top = heads[i, cell] + length[i] * cells[cell][1]
                        top += SLACK * (abs(float(heads[i, cell])) + length[i] * cells[cell][1] + 1)
                        if least is None or top >= least:
                            out += [(a + s, query_id, part["v"].iloc[i], least) for s in range(n)]
            yield pd.DataFrame(out, columns=["shard", "query_id", "q", "least"]).astype({"least": "Int64"})

    asked_once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = asked_once.mapInPandas(route, "shard long, query_id long, q array<long>, least long")

    def walk(key, tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held_pages, out = unpack(tree, dim), []
        for x in asked.itertuples():
            least = -math.inf if pd.isna(x.least) else int(x.least)
            out += [(x.query_id, i, s) for s, i in search(held_pages, x.query_id, _matrix([x.q], dim)[0], k, least)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = pages.groupBy("shard").cogroup(routed.groupBy("shard")).applyInPandas(walk, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = f"""WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}"""
