"""Operator 8: URL filter by rules, and by a character language-model ratio where no rule fits.

Two variable-order Markov models (contexts of up to ORDER characters, Witten-Bell interpolation) are counted
over every URL that a rule allows, and over every one that a rule blocks, but for a fifth (by a hash of page_id and
URL) that calibrates: the
threshold on the length-normalised log-likelihood difference is where most of that fifth, each side weighed
alike, is judged right. Counts are summed in Spark; the driver gets the distinct ones, whose number grows with the URLs.

Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?', '#' or
the end; null or no '://': both empty. A rule 'host/path' fits its host and all subdomains if the path starts
with '/path'; of those that fit the longest wins. The models learn from and judge the whole URL as it stands,
query and fragment too; null and empty URLs score 0. If no URL is allowed, or none blocked, nothing can be learned and all scores are 0; a score of at least the threshold (0 then) allows.
Repeated rows and null page_ids each get their result; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, row_chunks, table, text_buffer

ORDER = 4
_BITS = 8 * (ORDER + 1)
BINS = 2000
SPAN = 10.0
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, the row, the context and the context with the character, of each character and end. Both are
    the order and the bytes themselves, packed into 64 bits, so different ones never meet."""
    n = np.diff(at)
    ends = np.cumsum(n + ORDER + 1)
    begin = ends - n - ORDER - 1
    padded = np.full(int(ends[-1]) if len(n) else 0, 2, np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    padded[begin[row] + ORDER + np.arange(len(data)) - at[row]] = data
    padded[ends - 1] = 3
    rows = np.repeat(np.arange(len(n)), n + 1)
    i = begin[rows] + ORDER + np.arange(len(rows)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    before = np.zeros(len(i), np.int64)
    for k in range(ORDER + 1):
        if k:
            before |= padded[i - k].astype(np.int64) << 8 * (k - 1)
        yield rows, before | k << _BITS, before << 8 | padded[i] | k << _BITS


def _context(gram: np.ndarray) -> np.ndarray:
    return gram >> _BITS << _BITS | (gram & (1 << _BITS) - 1) >> 8


class Markov:
    """Counts under exact keys, as many as there are: 16 bytes a gram and 24 a context. Each gram is added once, all before log()."""

    def __init__(self) -> None:
        self.added: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gram, self.count, self.context, self.total, self.kinds = (np.zeros(0, np.int64) for _ in range(5))

    def add(self, context: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.added.append((context, gram, n))

    def pack(self) -> Markov:
        if self.added:
            context, gram, n = (np.concatenate(x) for x in zip(*self.added, strict=True))
            self.added = []
            by = np.argsort(gram)
            self.gram, self.count = gram[by], n[by]
            self.context, of = np.unique(context, return_inverse=True)
            self.kinds, self.total = np.bincount(of), np.bincount(of, n)
        return self

    def log(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        self.pack()
        # the longest gram tells all of a character's contexts
        _, first, same = np.unique(grams[-1][2], return_index=True, return_inverse=True)
        p = np.full(len(first), 1 / 256)
        for _, context, gram in grams:
            total, kinds = (_found(self.context, x, context[first]) for x in (self.total, self.kinds))
            p = np.where(total > 0, (_found(self.gram, self.count, gram[first]) + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.bincount(grams[0][0], np.log(p)[same], minlength=rows)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, 0 of those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def fit(judged: DataFrame) -> tuple[Markov, Markov] | None:
    """Models of the allowed and of the blocked rows of judged (said, allowed)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch["said"])
            allowed = batch["allowed"].to_numpy(zero_copy_only=False)
            for i, j in row_chunks(at):
                for rows, _, gram in _grams(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                    v, n = np.unique((gram << 1) | allowed[i + rows], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((v & 1).astype(bool)), pa.array(v >> 1), pa.array(n.astype(np.int64))], ["allowed", "gram", "n"])

    models = {True: Markov(), False: Markov()}
    counts = judged.mapInArrow(lean(count), "allowed boolean, gram long, n long").groupBy("allowed", "gram").agg(F.sum("n").alias("n"))
    for b in counts.toArrow().to_batches():
        of = b["allowed"].to_numpy(zero_copy_only=False)
        for side, m in models.items():
            gram, n = (b[c].to_numpy()[of == side] for c in ("gram", "n"))
            m.add(_context(gram), gram, n)
    good, bad = models[True].pack(), models[False].pack()
    return (good, bad) if len(good.gram) and len(bad.gram) else None


def scored(df: DataFrame, models: tuple[Markov, Markov] | None) -> DataFrame:
    """df (with said) and score: the difference of the models' log-likelihoods a character."""
    if models is None:
        return df.withColumn("score", F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(models)
    names = df.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = shared.value
        for batch in batches:
            data, at = text_buffer(batch["said"])
            for i, j in row_chunks(at):
                grams = list(_grams(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                n = np.diff(at[i : j + 1])
                x = np.where(n > 0, (good.log(grams, j - i) - bad.log(grams, j - i)) / (n + 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(x)], [*names, "score"])

    return df.mapInArrow(lean(score), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", score double")


def calibrated(judged: DataFrame) -> float:
    """The threshold at which the mean of both sides' shares judged right is largest, from a histogram."""
    bin_ = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score"))) + SPAN) / (2 * SPAN) * BINS).cast("int")
    right = np.zeros((2, BINS + 1))
    for r in judged.groupBy("allowed", bin_.alias("b")).count().collect():
        right[int(r["allowed"]), r["b"]] += r["count"]
    if not right.sum(1).all():
        return 0.0
    share = right / right.sum(1, keepdims=True)
    gain = np.concatenate([[0], np.cumsum(share[0])]) + 1 - np.concatenate([[0], np.cumsum(share[1])])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] / BINS * 2 * SPAN - SPAN)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every page (page_id, url)."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("url", F.lit("")).alias("said"))
    parts = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    ruled = parts.where("fit IS NOT NULL").select("said", (F.col("fit.verdict") == "allow").alias("allowed"), (F.crc32(F.concat_ws(" ", F.col("page_id").cast("string"), "said").cast("binary")) % 5 == 0).alias("apart"))
    models = fit(ruled.where("NOT apart").drop("apart"))
    limit = calibrated(scored(ruled.where("apart").drop("apart"), models)) if models else 0.0
    out = scored(parts.select("page_id", "host", "path", "said", F.col("fit.verdict").alias("v"), F.col("fit.rule").alias("rule")), models)
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce("v", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
