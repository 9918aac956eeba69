"""Operator 2: exact top-k search by inner product with MaxScore.

A dimension is a term, its posting list the vectors with a component other than 0. Candidates are dealt into
shards; a query visits every shard. There a list's greatest and least component bound what its term can add to a score.
The score to beat is the k-th best of the shards the task has searched before, or of a few vectors that lead on the
strongest terms and are scored in full. The weakest terms that together cannot reach it are non-essential: only the
essential lists are traversed, so a vector in none of them is never touched, and the others are probed, strongest
first, for the vectors that can still compete. Each
shard keeps its best k, and the shards' results are merged by a window over the query's rows.

Queries travel to the shards in blocks of rows, not as a broadcast; a task holds one shard's lists and one
block. Components are floor(scale * x), x as double. Vectors that are null or hold null or non-finite
components take no part, nor do rows without id. Shorter vectors end in zeros. Queries with the same id and
vector are one query; a query never finds rows with its own id. Ties go to the smaller id. Fewer candidates
than k: all. Scores that might not fit 64 bits are an error. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, table

K = 20
SCALE = 64
SHARD_ROWS = 8192
GROUP = 8  # terms added at a time


def quantized(df: DataFrame, id_: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, x (array of long): the rows that take part."""
    finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(id_).cast("long").alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def _matrix(column) -> np.ndarray:
    at, flat = column.offsets.to_numpy(), column.flatten().to_numpy()
    n = np.diff(at)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], n)] = flat
    return out


class Lists:
    """A shard's posting lists. Lists that many vectors are in are kept as a row without places."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.high, self.low = x.max(0), x.min(0)
        self.peak = int(np.abs(x).max(initial=0))
        self.columns = np.ascontiguousarray(x.T)
        self.places = {d: np.flatnonzero(c) for d, c in enumerate(self.columns) if (c != 0).mean() < 0.25}
        self.full = (x != 0).all(0)
        self.float = {t: self.columns.astype(t) for t in (np.float32,)}

    def numbers(self, q: np.ndarray) -> np.ndarray:
        """The lists in the fastest type that adds up this query's scores exactly."""
        most = self.peak * int(np.abs(q).max(initial=0)) * len(self.columns)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else None
        if kind is None:
            return self.columns
        if kind not in self.float:
            self.float[kind] = self.columns.astype(kind)
        return self.float[kind]

    def traverse(self, terms: np.ndarray, q: np.ndarray, columns: np.ndarray, scores: np.ndarray, touched: np.ndarray) -> None:
        """Adds the terms to the scores of the vectors in their lists, and marks these."""
        dense = [t for t in terms if t not in self.places]
        if dense:
            scores += q[dense] @ columns[dense]
            touched[:] = True
        for t in terms:
            if t in self.places:
                at = self.places[t]
                scores[at] += q[t] * columns[t, at]
                touched[at] = True

    def top(self, own: int, q: np.ndarray, k: int, beat: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best k of those that reach `beat`, best first."""
        n_terms = len(self.columns)
        q = np.pad(q, (0, max(n_terms - len(q), 0)))[:n_terms]
        columns = self.numbers(q)
        qs = q.astype(columns.dtype)
        most = np.maximum(q * self.high, q * self.low)
        most = np.where(self.full, most, np.maximum(most, 0))  # who isn't in a list adds 0
        terms = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[terms][::-1])[::-1], 0)  # the most that terms from here on can add
        scores, touched = np.zeros(len(self.ids), columns.dtype), np.zeros(len(self.ids), bool)
        if beat is not None and rest[0] < beat:
            return self.ids[:0], np.zeros(0, np.int64)
        # the strongest terms are essential in any case
        split = min(GROUP, n_terms)
        self.traverse(terms[:split], qs, columns, scores, touched)
        lead = np.flatnonzero(touched)
        if len(lead) > 4 * k:
            # vectors that lead on them, in full
            lead = lead[np.argpartition(-scores[lead], 4 * k)[: 4 * k]]
        lead = lead[self.ids[lead] != own]
        if len(lead) >= k:
            reached = int(np.partition(qs @ columns[:, lead], len(lead) - k)[len(lead) - k])
            beat = reached if beat is None else max(beat, reached)
        essential = n_terms if beat is None or not (rest < beat).any() else int(np.flatnonzero(rest < beat)[0])
        if not self.places and 4 * essential > 3 * n_terms:
            # nearly all lists, each with nearly all vectors: all of them at once
            scores, split = qs @ columns, n_terms
        elif essential > split:
            self.traverse(terms[split:essential], qs, columns, scores, touched)
            split = essential
        live = None if beat is None or touched.all() else np.flatnonzero(touched)
        if live is not None:
            scores = scores[live]
        for a in range(split, n_terms, GROUP):
            can = scores + rest[a] >= beat
            if not can.all():
                live = np.flatnonzero(can) if live is None else live[can]
                scores = scores[can]
            part = terms[a : a + GROUP]
            scores = scores + (qs[part] @ columns[part] if live is None else qs[part] @ columns[np.ix_(part, live)])
        ids = self.ids if live is None else self.ids[live]
        keep = ids != own
        if beat is not None:
            keep &= scores >= beat
        keep = np.flatnonzero(keep)
        best = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
        return ids[best], scores[best].astype(np.int64)


def fits(queries: DataFrame, candidates: DataFrame) -> None:
    """Raises if a score might not fit 64 bits."""
    bounds = []
    for df in (queries, candidates):
        size = F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))
        r = df.agg(F.max(size).alias("peak"), F.max(F.size("x")).alias("n")).first()
        bounds.append((r["peak"] or 0.0, r["n"] or 0))
    if any(peak >= 2.0**62 for peak, _ in bounds) or bounds[0][0] * bounds[1][0] * min(n for _, n in bounds) >= 2.0**62:
        raise ArithmeticError("scores of these vectors may not fit 64 bits")


def search(queries: DataFrame, candidates: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's best k candidates. Both sides: id, x."""
    fits(queries, candidates)
    shards = max(1, -(-candidates.count() // shard_rows))
    held = candidates.select(F.pmod(F.xxhash64("id", "x"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("q"), "x")
    asked = queries.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", F.xxhash64("x").alias("q"), "x")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, lists = None, [], [], None
        beat: dict[tuple[int, int], int] = {}  # by query: the k-th best score in a shard searched before
        for batch in batches:
            at = batch["shard"].to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                if at[i] != shard:
                    shard, ids, rows, lists = at[i], [], [], None
                part = batch.slice(i, j - i)
                x, kind, of, q = _matrix(part["x"]), part["kind"].to_numpy(), part["id"].to_numpy(), part["q"].to_numpy()
                if (kind == 0).any():
                    ids.append(of[kind == 0])
                    rows.append(x[kind == 0])
                if (kind == 1).any() and ids:
                    if lists is None:
                        wide = max(r.shape[1] for r in rows)
                        lists = Lists(np.concatenate(ids), np.concatenate([np.pad(r, ((0, 0), (0, wide - r.shape[1]))) for r in rows]))
                    out = []
                    for query, h, v in zip(of[kind == 1].tolist(), q[kind == 1].tolist(), x[kind == 1], strict=True):
                        found, score = lists.top(query, v, k, beat.get((query, h)))
                        out.append((query, h, found, score))
                        if len(score) == k:
                            beat[query, h] = max(int(score[-1]), beat.get((query, h), int(score[-1])))
                    n = [len(o[2]) for o in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], n), pa.int64()), pa.array(np.repeat(np.array([o[1] for o in out], np.int64), n)), pa.array(np.concatenate([o[2] for o in out])), pa.array(np.concatenate([o[3] for o in out]))], ["query_id", "q", "vec_id", "score"])

    found = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(find), "query_id long, q long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors.where("id % 20 = 0"), vectors)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""
