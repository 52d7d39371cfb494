"""Exact top-k inner products: exhaustive term-at-a-time accumulation over blocks.

Candidates and queries are cut into blocks and every (query block, candidate block) pair is one
group. In a group the candidates become postings per term (vector position); each non-zero entry
of a query scatters ``weight * posting`` into a dense score array (a term that many candidates have
is kept as a column and added as a whole), a partition selection takes the best k, and the k best of all blocks are merged per query by a ranking window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import materialise, with_row_id


def quantise(vector: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; NULL if the vector is NULL or holds a NULL or non-finite one."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _scores(k: int):
    def run(queries, candidates):
        import numpy as np
        import pandas as pd

        out = {"qrid": [], "query_id": [], "qnull": [], "vec_id": [], "vnull": [], "crid": [], "score": []}
        if len(queries) and len(candidates):
            # Postings: for each term the candidates that have it and their weights.
            lengths = np.fromiter(map(len, candidates["v"]), np.int64, len(candidates))
            terms = np.concatenate([np.arange(n) for n in lengths])
            rows = np.repeat(np.arange(len(candidates)), lengths)
            values = np.concatenate([np.asarray(v, np.int64) for v in candidates["v"]])
            live = values != 0
            order = np.argsort(terms[live], kind="stable")
            terms, rows, values = terms[live][order], rows[live][order], values[live][order]
            cuts = np.searchsorted(terms, np.arange(int(lengths.max()) + 1))
            # Columns for terms that many candidates have: adding one up is faster than scattering its postings.
            widest = max(max(map(len, queries["v"])), int(lengths.max()))
            most = [max(abs(int(v.min())), abs(int(v.max()))) if len(v) else 0 for v in (values, np.concatenate([np.asarray(v, np.int64) for v in queries["v"]]))]
            kind = np.int32 if most[0] * most[1] * widest < 2**31 and max(most) < 2**31 else np.int64
            dense: dict[int, np.ndarray] = {}
            for term in np.flatnonzero(4 * np.diff(cuts) >= len(candidates)).tolist():
                at = slice(cuts[term], cuts[term + 1])
                dense[term] = np.zeros(len(candidates), kind)
                dense[term][rows[at]] = values[at]
            added = np.empty(len(candidates), kind)
            crid, ids, null = (candidates[c].to_numpy() for c in ("rid", "vec_id", "null"))
            for qrid, qid, qnull, vector in zip(*(queries[c] for c in ("rid", "vec_id", "null", "v")), strict=True):
                score = np.zeros(len(crid), kind)
                for term, weight in enumerate(vector):
                    if weight and term in dense:
                        score += np.multiply(dense[term], kind(weight), out=added)
                    elif weight and term < len(cuts) - 1:
                        at = slice(cuts[term], cuts[term + 1])
                        score[rows[at]] += (int(weight) * values[at]).astype(kind)  # a row is once in a term's postings
                score = score.astype(np.int64)
                pool = np.flatnonzero(crid != qrid)
                if len(pool) > k:
                    floor = np.partition(score[pool], len(pool) - k)[len(pool) - k]
                    pool = pool[score[pool] >= floor]
                best = pool[np.lexsort((crid[pool], ids[pool], null[pool], -score[pool]))][:k]
                for name, got in (("qrid", qrid), ("query_id", qid), ("qnull", qnull)):
                    out[name] += [got] * len(best)
                for name, got in (("vec_id", ids), ("vnull", null), ("crid", crid), ("score", score)):
                    out[name] += got[best].tolist()
        return pd.DataFrame(out).astype({c: "bool" if c.endswith("null") else "int64" for c in out})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "v",
          query_block: int = 1024, candidate_block: int = 8192) -> DataFrame:
    """The k highest inner products of each query row with every other row: query_id, rank, vec_id, score.

    ``vector_col`` holds arrays of whole numbers, ``is_query`` marks the queries. Rows whose vector is
    NULL take no part; shorter vectors count as if filled with zeros; an empty table gives no rows.
    Ties go to the smaller id, NULL ids last. Rows with equal ids are different rows: a query leaves
    out itself alone, and each of several equal queries gets its own ranks.
    """
    ident = F.col(id_col).cast("long")
    kept = vectors.select(F.coalesce(ident, F.lit(0)).alias("vec_id"), ident.isNull().alias("null"),
                          F.col(vector_col).cast("array<long>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialise(with_row_id(kept.where(F.col("v").isNotNull())))
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    cbs, qbs = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(nq / query_block))
    block = lambda count: F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.where("q").select("rid", "vec_id", "null", "v", block(qbs).alias("qb"), every(cbs).alias("cb"))
    candidates = rows.select("rid", "vec_id", "null", "v", every(qbs).alias("qb"), block(cbs).alias("cb"))
    best = (queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))
            .applyInPandas(_scores(k), "qrid long, query_id long, qnull boolean, vec_id long, vnull boolean, crid long, score long"))
    w = W.partitionBy("qrid").orderBy(F.col("score").desc(), "vnull", "vec_id", "crid")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    number = lambda name, null: F.when(~F.col(null), F.col(name)).alias(name)
    return ranked.select(number("query_id", "qnull"), "rank", number("vec_id", "vnull"), "score")
