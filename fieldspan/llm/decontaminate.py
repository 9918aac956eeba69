"""Operator 10: benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of letters a-z, digits and characters from U+0080 on. A window is 10
consecutive words of an item; an item of fewer words, but not none, is one window. Both sides keep the least
hash of every 6 consecutive 5-grams, so two texts that share 10 words share a kept fingerprint; fingerprints
are joined, and each hit is extended to the windows that can hold it, which are compared as a whole. Shorter
items are too short for that guarantee: all their windows are kept and compared at every word.

The benchmark goes to the executors in blocks of at most BLOCK_WORDS words, so what is broadcast is bounded
however large the benchmark is; with more than one block the blocks' findings are merged by document.

Null and empty texts have no words and no hits. Repeated rows each get their result. Items without words
match nothing; items without an id mark words but are not listed. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, Rolling, kept_schema, lean, materialize, mix, row_chunks, row_key, small_batches, table, text_buffer, words_of

WINDOW, GRAM = 10, 5
BLOCK_WORDS = 1_000_000
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_SEED = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)

SPANS = "array<struct<start:int,end:int>>"


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and how many words stand before each row."""
    low = LOWER[data]
    s, e, first = words_of(low, at, WORD)
    return Rolling(low).at(s, e), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m] * _SEED[0]
    for j in range(1, n):
        out += words[j : m + j] * _SEED[j]
    return mix(out ^ np.uint64(n))


def fits(first: np.ndarray, n: int, m: int) -> np.ndarray:
    """For m grams of n words: whether each lies in one row."""
    room = np.zeros(m, bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            room[a : b - n + 1] = True
    return room


def winnow(grams: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Where a gram is the least of some `width` consecutive ones; windows: which of these count."""
    kept = np.zeros(len(grams), bool)
    m = len(grams) - width + 1
    if m <= 0:
        return kept
    least = grams[:m].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : m + j], out=least)
    for j in range(width):
        kept[j : m + j] |= (grams[j : m + j] == least) & windows[:m]
    return kept


class Members:
    """Which of many hashes are in a sorted set: a bitmap of the top bits first, then a search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into x of the members, and their places in the set."""
        i = np.flatnonzero(self.bits[(x >> np.uint64(44)).astype(np.int64)])
        if not len(i) or not len(self.values):
            return i[:0], i[:0]
        k = np.minimum(np.searchsorted(self.values, x[i]), len(self.values) - 1)
        ok = self.values[k] == x[i]
        return i[ok], k[ok]


class Index:
    """The windows of a block of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str]]):
        data, at = text_buffer(pa.array([t for _, t in items], pa.string()))
        words, first = word_hashes(data, at)
        n = np.diff(first)
        self.ids = [i for i, _ in items]
        row = np.repeat(np.arange(len(items)), n)
        self.windows: dict[int, tuple[Members, np.ndarray, np.ndarray]] = {}
        for size in sorted({int(x) for x in np.minimum(n, WINDOW)} - {0}):
            g = gram_hashes(words, size)
            ok = fits(first, size, len(g)) & ((n[row[: len(g)]] == size) | (size == WINDOW))
            members = Members(g[ok])
            place, items_ = np.searchsorted(members.values, g[ok]), row[: len(g)][ok]
            pairs = np.unique(np.stack([place, items_], 1), axis=0).reshape(-1, 2)
            self.windows[size] = (members, np.searchsorted(pairs[:, 0], np.arange(len(members.values) + 1)), pairs[:, 1])
        g = gram_hashes(words, GRAM)
        kept = winnow(g, fits(first, WINDOW, max(len(g) - WINDOW + GRAM, 0)), WINDOW - GRAM + 1)
        self.prints = Members(g[kept])

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """The occurrences of windows, by size: first words, size, places in the size's sorted windows."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        for size, (members, _, _) in self.windows.items():
            if size < WINDOW:
                g = gram_hashes(words, size)
                i, k = members.find(g)
                ok = fits(first, size, len(g))[i]
                found.append((i[ok], size, k[ok]))
            else:
                g = gram_hashes(words, GRAM)
                m = max(len(words) - WINDOW + 1, 0)
                whole = fits(first, WINDOW, m)
                kept = np.flatnonzero(winnow(g, whole, WINDOW - GRAM + 1))
                hit, _ = self.prints.find(g[kept])
                start = np.unique((kept[hit][:, None] - np.arange(WINDOW - GRAM + 1)[None]).ravel())
                start = start[(start >= 0) & (start < m)]
                start = start[whole[start]]
                g10 = np.zeros(len(start), np.uint64)
                for j in range(WINDOW):
                    g10 += words[start + j] * _SEED[j]
                i, k = members.find(mix(g10 ^ np.uint64(WINDOW)))
                found.append((start[i], WINDOW, k))
        return found


def findings(index: Index, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str], list[int]]]:
    """For each row: words, words hit, hit spans, ids of the items that occur."""
    words, first = word_hashes(data, at)
    edge = np.zeros(len(words) + 1, np.int64)
    rows, items = [], []
    for start, size, place in index.search(words, first):
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size, -1)
        _, offset, of = index.windows[size]
        n = offset[place + 1] - offset[place]
        rows.append(np.repeat(np.searchsorted(first, start, side="right") - 1, n))
        items.append(of[np.repeat(offset[place], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))] if len(n) else of[:0])
    rows_, items_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, items))
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    pairs = np.unique(rows_ * max(len(index.ids), 1) + items_)
    by_row = np.searchsorted(pairs, np.arange(len(at)) * max(len(index.ids), 1))
    for r in range(len(at) - 1):
        a, b = int(first[r]), int(first[r + 1])
        n_hit = int(total[b] - total[a])
        if not n_hit:
            yield b - a, 0, [], []
            continue
        x = np.concatenate([[False], hit[a:b], [False]])
        turns = np.flatnonzero(x[1:] != x[:-1]).tolist()
        ids = {index.ids[p % len(index.ids)] for p in pairs[by_row[r] : by_row[r + 1]].tolist()}
        yield b - a, n_hit, list(zip(turns[::2], turns[1::2], strict=True)), sorted(i for i in ids if i is not None)


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in blocks of about `most` characters' worth of words; one block at a time is on the driver."""
    held, size = [], 0
    for item in benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).alias("text")).distinct().toLocalIterator():
        held.append((item[0], item[1]))
        size += len(item[1]) // 2 + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of hit words), item_ids (sorted strings) of every document, and columns to keep, named _column."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [f"_{c}" for c in keep]
    schema = f"doc_id long, k1 long, k2 long{kept_schema(docs, keep)}, n_words long, n_hit long, spans {SPANS}, item_ids array<string>"

    def scan(index) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = text_buffer(batch["text"])
                for i, j in row_chunks(at, 1 << 20):
                    found = list(findings(index.value, data[at[i] : at[j]], at[i : j + 1] - at[i]))
                    n, hit, spans, ids = map(list, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(i, j - i), batch["k1"].slice(i, j - i), batch["k2"].slice(i, j - i), *(batch[c].slice(i, j - i) for c in kept), pa.array(n, pa.int64()), pa.array(hit, pa.int64()),
                         pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(ids, pa.list_(pa.string()))],
                        ["doc_id", "k1", "k2", *kept, "n_words", "n_hit", "spans", "item_ids"],
                    )

        return row_key(docs, keep).mapInArrow(lean(search), schema)

    parts = blocks(benchmark, block_words)
    held, last = next(parts, []), next(parts, None)
    if last is None:
        return scan(spark.sparkContext.broadcast(Index(held))).drop("k1", "k2")
    index = spark.sparkContext.broadcast(Index(held))
    rows = materialize(scan(index))
    index.destroy()
    hits = rows.where("n_hit > 0").select("k1", "k2", "spans", "item_ids")
    while last is not None:
        # one block after the other: each one's findings are written before the next is broadcast
        index = spark.sparkContext.broadcast(Index(last))
        hits = hits.unionByName(materialize(scan(index).where("n_hit > 0").select("k1", "k2", "spans", "item_ids")))
        index.destroy()
        last = next(parts, None)
    merged = hits.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("i"))
    joined = F.aggregate(
        "s", F.array().cast(SPANS),
        lambda out, x: F.when((F.size(out) > 0) & (x["start"] <= F.element_at(out, -1)["end"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(out, F.array(x))),
    )
    merged = merged.select("k1", "k2", joined.alias("s"), "i")
    out = rows.drop("spans", "item_ids", "n_hit").join(merged, ["k1", "k2"], "left")
    spans = F.coalesce("s", F.array().cast(SPANS))
    return out.select("doc_id", *kept, "n_words", F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"), spans.alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("item_ids"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - least(len(w), 10) + 2, 1))) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
