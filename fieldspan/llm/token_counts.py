"""Operator 7: exact counts of tokens for every context limit.

Documents are aggregated by encoded length. With the suffix sums of that histogram, any limit L has its
answers: documents and tokens in all, documents longer than L, tokens left when each document is cut to L.
The histogram has a row a length at most, so it is bounded by the longest document, not by the corpus; suffix
sums are taken in blocks of lengths, so no task needs all of it.

Null text has length 0, as has empty text. Repeated rows count each time. An empty table gives no row; other
columns are ignored. Special tokens are not added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._byte_bpe import TOKENIZER, encoder
from ._common import lean, materialize, small_batches, table

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length, docs: the histogram of docs (text), pre-aggregated in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = [np.diff(at) for _, _, at, _ in enc.batches(batch["text"])]
            v, c = np.unique(np.concatenate([np.zeros(0, np.int64), *n]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c, pa.int64())], ["length", "docs"])

    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(count), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length, as a context limit: docs of that length, docs and tokens that reach it (the suffix
    sums), docs beyond it, tokens if all are cut to it, share of docs up to it."""
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), zero).alias("d"), F.coalesce(F.sum("t").over(above), zero).alias("t"), F.sum("d").over(everything).alias("n"), F.sum("t").over(everything).alias("all"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    x = h.join(blocks, "block").select(
        "length", "docs", "n", "all",
        (F.sum("docs").over(inside) + F.col("d")).alias("docs_reaching"),
        (F.sum(F.col("docs") * F.col("length")).over(inside) + F.col("t")).alias("tokens_reaching"),
    )
    beyond = F.col("docs_reaching") - F.col("docs")
    return x.select(
        F.col("length").alias("context_limit"), "docs", "docs_reaching", "tokens_reaching", beyond.alias("docs_cut"),
        (F.col("all") - F.col("tokens_reaching") + F.col("docs_reaching") * F.col("length")).alias("tokens_kept"),
        (F.col("tokens_reaching") - F.col("docs_reaching") * F.col("length")).alias("tokens_cut"),
        ((F.col("n") - beyond) / F.col("n")).alias("share_whole"),
    )


def _rows(found: DataFrame, rows: list[Column]) -> DataFrame:
    return found.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """q, length: for each q the least length that a share q of the documents doesn't exceed. One aggregate for all of them."""
    found = sums.agg(*[F.min(F.when(F.col("share_whole") >= float(q), F.col("context_limit"))).alias(f"l{i}") for i, q in enumerate(at)])
    return _rows(found, [F.struct(F.lit(float(q)).alias("q"), F.col(f"l{i}").alias("length")) for i, q in enumerate(at)]).where("length IS NOT NULL")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """tokens_kept and docs_cut for any limits, whether some document has that length or not. One aggregate for all of them."""
    above = [F.min(F.when(F.col("context_limit") > int(x), F.struct("context_limit", "docs_reaching", "tokens_kept"))).alias(f"a{i}") for i, x in enumerate(limits)]
    found = sums.agg(F.max("tokens_kept").alias("all"), *above)

    def row(i: int, x: int) -> Column:
        # below the next length, each document that reaches it loses that much more; beyond the longest nothing is lost
        a = F.col(f"a{i}")
        kept = F.coalesce(a["tokens_kept"] - a["docs_reaching"] * (a["context_limit"] - int(x)), F.col("all"))
        return F.struct(F.lit(int(x)).cast("long").alias("context_limit"), kept.alias("tokens_kept"), F.coalesce(a["docs_reaching"], F.lit(0).cast("long")).alias("docs_cut"))

    return _rows(found, [row(i, x) for i, x in enumerate(limits)])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # the histogram is used twice and must not be counted twice
    return suffix_sums(materialize(lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))))
