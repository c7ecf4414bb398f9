"""Exact top-k inner products by columnar branch-and-bound.

Vectors are dealt into blocks that are stored dimension by dimension. Scores accumulate block of
dimensions by block of dimensions; what the remaining dimensions can still add is bounded by the
product of the remaining norms (Cauchy-Schwarz), and candidates whose bound falls below the k-th
best certain score are compacted away. Each pair of a vector block and a query block is one task,
so neither side is ever gathered whole.

Blocks belong to bands of norm. Every query first meets one block of the longest vectors, which gives
a score that its k best reach at least; a band whose longest vector cannot reach it, whatever the
directions, is never sent to the query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from modweave.runtime import cut

#: Rows of a vector block and of a query block: bounds on what a task holds.
VECTORS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 16_384
#: Bands of norm, of about equally many vectors.
BANDS = 16
DIMENSIONS_PER_STEP = 8


def _matrix(arrays, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width), np.int64)
    for row, a in zip(out, arrays, strict=True):
        row[: len(a)] = a
    return out


def _rest_norms(x: np.ndarray, step: int) -> np.ndarray:
    """Norm of the dimensions from each step's start on; a row per step, and a last one of zeros."""
    squares = np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.shape[1], step), axis=1)
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([rest, np.zeros((len(x), 1))], axis=1)).T


def search_block(vectors: np.ndarray, vec_ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int, step: int = DIMENSIONS_PER_STEP):
    """For each query: positions and scores of its k best vectors, ties to the smaller id."""
    width = vectors.shape[1]
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, width)
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object  # sums stay exact
    columns, heads = np.ascontiguousarray(vectors.T.astype(kind)), queries.astype(kind)
    rest, rest_q = _rest_norms(vectors, step), _rest_norms(queries, step)
    for j in range(len(queries)):
        alive = np.flatnonzero(rows != query_rows[j])
        score = np.zeros(len(alive), kind)
        for s, at in enumerate(range(0, width, step)):
            part = columns[at : at + step]
            score = score + heads[j, at : at + step] @ (part if len(alive) == part.shape[1] else part[:, alive])
            if len(alive) > k and at + step < width:
                slack = rest_q[s + 1, j] * rest[s + 1][alive] * (1 + 1e-9) + 1e-6
                now = score.astype(np.float64)
                bar = np.partition(now - slack, len(alive) - k)[len(alive) - k]
                keep = now + slack >= bar - 1e-9 * abs(bar)
                alive, score = alive[keep], score[keep]
        if len(alive) > k:
            bar = np.partition(score, len(alive) - k)[len(alive) - k]
            keep = score >= bar
            alive, score = alive[keep], score[keep]
        order = np.lexsort((vec_ids[alive], -score.astype(np.int64)))[:k]
        yield j, alive[order], score[order].astype(np.int64)


def quantised(embedding: Column | str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a long; null for vectors that take no part."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    real = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(real, F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    Rows that satisfy ``is_query`` are queries; every other row is a candidate, and so is every
    query for the others. Ties go to the smaller id. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. A shorter vector counts as
    padded with zeros. A repeated row is a candidate and, if a query, a query of its own. Fewer
    candidates than k give fewer rows; empty input gives none. Scores must fit a long. Other
    columns, whatever their names, are not read.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    base = cut(base.filter("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("norm", norm))
    n, m, width = base.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    if not n or not m:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, parts = max(1, width), -(-m // QUERIES_PER_BLOCK)
    cuts = sorted(set(base.agg(F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 1000)).first()[0]))
    band = sum(((F.col("norm") > c).cast("int") for c in cuts), F.lit(0))
    sizes = {r["band"]: r for r in base.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    blocks = {b: -(-r["n"] // VECTORS_PER_BLOCK) for b, r in sizes.items()}
    first = {b: sum(blocks[x] for x in blocks if x > b) for b in blocks}  # the longest vectors are in block 0
    named = lambda of: F.element_at(F.create_map(*(F.lit(x) for b, v in sorted(of.items()) for x in (b, v))), band)
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts).cast("long"))
    placed = base.select("vec_id", "v", "row", (named(first) + F.pmod(F.xxhash64("row"), named(blocks).cast("long"))).cast("long").alias("block"))
    queries = base.filter("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_v"), F.col("row").alias("query_row"), F.col("norm").alias("query_norm"), part.alias("query_part"))

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            ids, names, rows = data["vec_id"].to_numpy(), asked["query_id"].to_numpy(), asked["query_row"].to_numpy()
            for j, at, score in search_block(_matrix(data["v"], width), ids, data["row"].to_numpy(), _matrix(asked["query_v"], width), rows, k):
                out.append(pd.DataFrame({"query_id": names[j], "query_row": rows[j], "vec_id": ids[at], "row": data["row"].to_numpy()[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query_row", "vec_id", "row", "score")})

    def searched(asked: DataFrame) -> DataFrame:
        """The best of each pair of a query and a block; a block is sent to those parts of the queries that want it."""
        wanted = asked.select("query_block", "query_part").distinct()
        data = placed.join(wanted, placed["block"] == wanted["query_block"]).select("vec_id", "v", "row", "block", F.col("query_part").alias("part"))
        return data.groupBy("block", "part").cogroup(asked.groupBy("query_block", "query_part")).applyInPandas(search, "query_id long, query_row long, vec_id long, row long, score long")

    found = cut(searched(queries.withColumn("query_block", F.lit(0).cast("long")).drop("query_norm")))
    bars = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    every = F.array(*(F.struct(F.lit(float(sizes[b]["most"])).alias("most"), F.lit(first[b]).cast("long").alias("at"), F.lit(blocks[b]).alias("n")) for b in sorted(blocks)))
    near = queries.join(bars, "query_row", "left").select("*", F.explode(every).alias("band"))
    reached = F.col("bar").isNull() | (F.col("query_norm") * F.col("band.most") * (1 + 1e-9) + 1e-6 >= F.col("bar"))
    asked = near.filter(reached).select("query_id", "query_v", "query_row", "query_part", F.explode(F.sequence(F.col("band.at"), F.col("band.at") + F.col("band.n") - 1)).alias("query_block"))
    found = found.unionByName(searched(asked.filter("query_block > 0")))
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
