"""Operator 4: removal of byte strings that occur twice, by bucket-pointer refinement of sampled suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else; strings never cross
documents. Sorting every suffix would shuffle many times the input, so suffixes are sampled where the text
itself says so: each window of LENGTH bytes is owned by the suffix in it whose first GRAM bytes hash least.
Equal windows have equal owners at equal offsets, so whether a window repeats is decided among the suffixes
of one bucket, and nothing is lost. Buckets are the sampled suffixes with equal first q-gram:

1. Suffixes of one bucket with the same surroundings are merged, first within a task's own texts, then among all; a
   merged suffix repeats with all its windows.
2. Buckets of one suffix are final: none of its windows repeats.
3. What is left is refined: the windows' bucket identifiers at q bytes are sorted by those of the offset q
   bytes on, which gives identifiers at 2q; these are reused for 4q = LENGTH. Positions alone in a bucket
   drop out at each step.

Buckets with more than HOT suffixes (or, in large tables, more than a quarter of a partition's) are known before from
counts. They are dealt by their surroundings too, and refined as rows of the whole table (a pre-aggregated count by
identifier) instead of in one task.

Null text is empty. Repeated rows count as further places: all their bytes go if they hold LENGTH bytes.
Texts shorter than LENGTH stay whole. Very long texts are worked on in overlapping tiles. Empty tables give
no rows. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Rolling, i64, kept_schema, lean, materialize, mix, row_chunks, row_key, small_batches, table, text_buffer, u64, whole_groups

LENGTH = 200
TILE = 1 << 19
HOT = 8192
FLUSH = 1 << 18  # suffixes that a task holds before it passes them on
_PLACE = 24  # bits of a packed key that hold the place; the rest holds the hash


def tiles(at: np.ndarray, length: int, most: int = TILE) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Groups of pieces (row, start in the row, bytes) of about `most` bytes. Long rows are cut into pieces
    that overlap by length - 1 bytes, so each window lies in exactly one; rows without a window are left out."""
    rows, starts, sizes, held = [], [], [], 0
    for r in range(len(at) - 1):
        n, a = int(at[r + 1] - at[r]), 0
        while n - a >= length:
            size = min(n - a, most + length - 1)
            if held and held + size > most:
                yield rows, starts, sizes
                rows, starts, sizes, held = [], [], [], 0
            rows.append(r)
            starts.append(a)
            sizes.append(size)
            held += size
            a += size - length + 1
    if rows:
        yield rows, starts, sizes


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams, where the least hash stands (of equal ones the first)."""
    key = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    return (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def sampled(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, place of the first owned window in its row, owner's distance from it, number of windows less one,
    bucket (hash of the owner's q-gram), surroundings (hash of all bytes of the owned windows)."""
    q = length // 4
    for rows, starts, sizes in tiles(at, length):
        piece = np.concatenate([data[at[r] + a : at[r] + a + n] for r, a, n in zip(rows, starts, sizes, strict=True)])
        ends = np.cumsum(sizes)
        begin = ends - sizes
        h = Rolling(piece)
        grams = h.grams(q)
        own = owners(grams, length - q + 1)
        real = np.ones(len(own), bool)
        for e in ends[:-1]:
            real[max(e - length + 1, 0) : e] = False
        first = real.copy()
        first[1:] &= (own[1:] != own[:-1]) | ~real[:-1]
        last = real.copy()
        last[:-1] &= (own[1:] != own[:-1]) | ~real[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        m = own[lo]
        which = np.searchsorted(ends, lo, side="right")
        bucket = grams[m]
        around = mix(h.at(lo, hi + length) + ((m - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
        yield np.asarray(rows)[which], lo - begin[which] + np.asarray(starts)[which], m - lo, hi - lo, bucket, around


def refine(data: np.ndarray, begin: np.ndarray, before: np.ndarray, count: np.ndarray, bucket: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """The windows that repeat, as places in the concatenation of the suffixes' windows.

    data, begin: the bytes of each suffix's windows and where they start; count: its windows; bucket: its bucket;
    times: how often it occurs in the whole table (2: more than once). `before` tells windows of one suffix apart by
    their distance from the owner."""
    q = length // 4
    h = Rolling(data)
    own = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = begin[own] + place
    salt = mix(bucket[own] + (before[own] - place).astype(np.uint64))
    weight = times[own]
    live = np.arange(len(own))
    ids = [_named(h.at(at + k * q, at + (k + 1) * q)) for k in range(4)]  # of the q-grams at the four offsets
    while True:
        _, inverse = np.unique(mix(ids[0]) + salt, return_inverse=True)
        keep = (np.bincount(inverse, weights=weight) >= 2)[inverse]
        live, salt, weight, ids = live[keep], salt[keep], weight[keep], [x[keep] for x in ids]
        if len(ids) == 1 or not len(live):
            return live
        # an identifier and that of the offset behind it name a string twice as long
        ids = [_named(mix(x) + y) for x, y in zip(ids[::2], ids[1::2], strict=True)]


def _named(x: np.ndarray) -> np.ndarray:
    """Bucket identifiers: the rank of each value among the sorted values."""
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])]


_FOUND = "kind int, k1 long, k2 long, lo int, dm int, dh int, bucket long, times int"
_SPAN, _ASKED, _ASKED_HOT = 0, 1, 2


def hot_buckets(docs: DataFrame, length: int, hot: int) -> np.ndarray:
    """The buckets that hold a fair part of a partition's suffixes, and `hot` at least, sorted; suffixes that tasks merge count once.

    Tasks report what is frequent among their own suffixes, so little is shuffled; a bucket with the limit's share
    of all suffixes has half of it, or more, in the reports. At most 8 buckets a shuffle partition (and 8192) come back."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1024)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def report() -> pa.RecordBatch:
            bucket, around = (np.concatenate(x) for x in zip(*found, strict=True))
            kinds = np.unique(mix(bucket + mix(around)), return_index=True)[1]
            v, n = np.unique(bucket[kinds], return_counts=True)
            total = len(kinds)
            keep = n >= max(2, total // (8 * parts))
            return pa.RecordBatch.from_arrays([pa.array(np.append(v[keep].view(np.int64), 0)), pa.array(np.append(n[keep], total)), pa.array(np.append(np.zeros(keep.sum(), bool), True))], ["bucket", "n", "all"])

        for batch in batches:
            data, at = text_buffer(batch["text"])
            for x in sampled(data, at, length):
                found.append(x[4:])
                held += len(x[4])
                if held > FLUSH:
                    yield report()
                    found, held = [], 0
        if found:
            yield report()

    counts = docs.select("text").mapInArrow(lean(frequent), "bucket long, n long, all boolean").groupBy("all", "bucket").agg(F.sum("n").alias("n"))
    # no more than 8 * parts buckets can hold half of the limit, and the total stands before them
    top = counts.where(F.col("all") | (F.col("n") >= hot // 2)).orderBy(F.desc("all"), F.desc("n")).limit(8 * parts + 1).toArrow()
    if not top.num_rows:
        return np.zeros(0, np.uint64)
    n, bucket = top["n"].to_numpy(), top["bucket"].to_numpy().view(np.uint64)
    least = max(hot, int(n[0]) // (4 * parts))
    return np.sort(bucket[1:][n[1:] >= least // 2])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that are equal in all columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


_SUFFIX = ["deal", "bucket", "around", "k1", "k2", "lo", "dm", "dh", "times"]


def _suffixes(length: int, hot):
    """The suffixes of a task's texts, one row for those of equal bucket and surroundings (times = 2: it stands for
    more), and the spans of those merged here (times = 0), joined within a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            k1, k2, lo, dm, dh, bucket, around = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            by = np.lexsort((around, bucket))
            new = _starts(bucket[by], around[by])
            several = ~new
            several[:-1] |= ~new[1:]
            first, again = by[new], by[several]
            if len(again):
                s, e = lo[again], lo[again] + dh[again] + length
                order = np.lexsort((s, k2[again], k1[again]))
                again, s, e = again[order], s[order], e[order]
                start = _starts(k1[again], k2[again])
                # starts and ends both rise within a document, as its suffixes own windows in turn
                start[1:] |= s[1:] > e[:-1]
                cut = np.flatnonzero(start)
                last = np.append(cut[1:], len(s)) - 1
                yield from rows(mix(k2[again][cut].view(np.uint64) + s[cut].astype(np.uint64)), np.zeros(len(cut), np.uint64), k1[again][cut], k2[again][cut], s[cut], np.zeros(len(cut)), e[last] - s[cut] - length, np.zeros(len(cut)), None)
            yield from rows(bucket[first], around[first], k1[first], k2[first], lo[first], dm[first], dh[first], 1 + several[new].astype(np.int8), hot.value)

        def rows(bucket, around, k1, k2, lo, dm, dh, times, hot_) -> Iterator[pa.RecordBatch]:
            deal = bucket
            if hot_ is not None and len(hot_):
                deal = np.where(_is_in(hot_, bucket), mix(bucket ^ around), bucket)
            out = pa.RecordBatch.from_arrays([i64(deal), i64(bucket), i64(around), pa.array(k1), pa.array(k2), *[pa.array(x.astype(np.int32)) for x in (lo, dm, dh, times)]], _SUFFIX)
            yield from (out.slice(i, 1 << 15) for i in range(0, out.num_rows, 1 << 15))

        for batch in batches:
            data, at = text_buffer(batch["text"])
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for row, lo, dm, dh, bucket, around in sampled(data, at, length):
                held.append((k1[row], k2[row], lo.astype(np.int32), dm.astype(np.int16), dh.astype(np.int16), bucket, around))
                size += len(lo)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _is_in(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[i] == x


def _decided(length: int, hot):
    """From suffixes by bucket and surroundings: spans of those that occur twice, and of each kind one suffix to be
    refined, where a bucket has more kinds than one and not all are removed already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket"], 1 << 21):
            t = t.combine_chunks()
            times = t["times"].to_numpy()
            done = t.filter(pa.array(times == 0))
            if done.num_rows:
                yield _found(done, _SPAN, np.zeros(done.num_rows, np.int32))
                t, times = t.filter(pa.array(times > 0)), times[times > 0]
            if not t.num_rows:
                continue
            bucket, around = u64(t["bucket"]), u64(t["around"])
            new = _starts(bucket, around)
            kind = np.cumsum(new) - 1
            total = np.bincount(kind, times).astype(np.int64)
            whole = (total[kind] > 1) & (times == 1)
            if whole.any():
                yield _found(t.filter(pa.array(whole)), _SPAN, times[whole])
            first = np.flatnonzero(new)
            b = np.cumsum(_starts(bucket[first])) - 1
            hot_ = _is_in(hot.value, bucket[first]) if len(hot.value) else np.zeros(len(first), bool)
            ask = hot_ | ((np.bincount(b)[b] > 1) & (np.bincount(b, total == 1)[b] > 0))
            for mark, wanted in ((_ASKED, ask & ~hot_), (_ASKED_HOT, ask & hot_)):
                if wanted.any():
                    yield _found(t.take(pa.array(first[wanted])), mark, np.minimum(total[wanted], 2).astype(np.int32))

    return run


def _found(t: pa.Table, kind: int, times: np.ndarray) -> pa.RecordBatch:
    t = t.combine_chunks()
    column = lambda c: t[c].chunk(0)
    return pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, kind, np.int32)), *[column(c) for c in ("k1", "k2", "lo", "dm", "dh", "bucket")], pa.array(times.astype(np.int32))], ["kind", "k1", "k2", "lo", "dm", "dh", "bucket", "times"])


_CUT = ["bucket", "window", "k1", "k2", "times", "lo", "dm", "dh", "bytes"]


def _cut(length: int):
    """The bytes of the suffixes asked for; of those in hot buckets a row for each window instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch["text"])
            offsets = batch["xs"].offsets.to_numpy()
            x = batch["xs"].flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            kind, lo, dm, dh, times = (x.field(c).to_numpy() for c in ("kind", "lo", "dm", "dh", "times"))
            bucket, k1, k2 = x.field("bucket").to_numpy(), batch["k1"].to_numpy()[row], batch["k2"].to_numpy()[row]
            begin = at[row] + lo
            size = dh.astype(np.int64) + length
            for i, j in row_chunks(np.concatenate([[0], np.cumsum(size)]), 1 << 20):
                small = np.flatnonzero(kind[i:j] == _ASKED) + i
                if len(small):
                    ends = np.cumsum(size[small])
                    place = np.arange(int(ends[-1])) + np.repeat(begin[small] - (ends - size[small]), size[small])
                    blob = pa.Array.from_buffers(pa.binary(), len(small), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[place])])
                    none = pa.nulls(len(small), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[small]), none, pa.array(k1[small]), pa.array(k2[small]), *[pa.array(y[small]) for y in (times, lo, dm, dh)], blob], _CUT)
                for y in (np.flatnonzero(kind[i:j] == _ASKED_HOT) + i).tolist():
                    n = int(dh[y]) + 1
                    p = np.arange(n)
                    window = Rolling(data[begin[y] : begin[y] + size[y]]).at(p, p + length)
                    same = [pa.array(np.full(n, v)) for v in (k1[y], k2[y], times[y])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket[y])), i64(window), *same, pa.array((lo[y] + p).astype(np.int32)), pa.array((dm[y] - p).astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary())], _CUT)

    return run


def _refined(length: int):
    """Spans of the windows that repeat within a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket"], 1 << 20):
            t = t.combine_chunks()
            times, lo, dh = t["times"].to_numpy(), t["lo"].to_numpy(), t["dh"].to_numpy()
            count = dh.astype(np.int64) + 1
            data, begin = text_buffer(t["bytes"])
            got = refine(data, begin, t["dm"].to_numpy().astype(np.int64), count, u64(t["bucket"]), times, length)
            first = np.cumsum(count) - count
            got = got[times[np.searchsorted(first, got, side="right") - 1] == 1]
            if len(got):
                own = np.searchsorted(first, got, side="right") - 1
                a, b = _runs(got + own)  # a gap between suffixes, so that no run crosses them
                own = np.searchsorted(first + np.arange(len(first)), a, side="right") - 1
                base = lo[own] - first[own] - own
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([t["k1"].combine_chunks().take(take), t["k2"].combine_chunks().take(take), pa.array((a + base).astype(np.int32)), pa.array((b + base + length).astype(np.int32))], ["k1", "k2", "s", "e"])

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """k1, k2, spans: bytes to remove, overlapping spans too, of documents (k1, k2, text)."""
    if length % 4:
        raise ValueError("length must be a multiple of 4")
    spark = keyed.sparkSession
    docs = keyed.select("k1", "k2", "text")
    small_batches(spark)
    found_hot = hot_buckets(docs, length, hot)
    shared = spark.sparkContext.broadcast(found_hot)
    suffixes = docs.mapInArrow(lean(_suffixes(length, shared)), "deal long, bucket long, around long, k1 long, k2 long, lo int, dm int, dh int, times int")
    found = suffixes.repartition("deal").sortWithinPartitions("bucket", "around").mapInArrow(lean(_decided(length, shared)), _FOUND)
    # both uses of what was found begin with this exchange, so within a job it is made once; the filter is that of the join below
    found = (materialize(found) if len(found_hot) else found).where("k1 IS NOT NULL AND k2 IS NOT NULL").groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "lo", "dm", "dh", "bucket", "times")).alias("xs"))
    whole = found.select("k1", "k2", F.expr(f"transform(filter(xs, x -> x.kind = {_SPAN}), x -> struct(x.lo AS s, x.lo + x.dh + {length} AS e))").alias("spans"))
    pieces = docs.join(found.where(F.exists("xs", lambda x: x["kind"] != _SPAN)), ["k1", "k2"]).mapInArrow(lean(_cut(length)), "bucket long, window long, k1 long, k2 long, times int, lo int, dm int, dh int, bytes binary")
    if len(found_hot):
        pieces = materialize(pieces)
    parts = pieces.where("window IS NULL").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_refined(length)), "k1 long, k2 long, s int, e int")
    if len(found_hot):
        rows = pieces.where("window IS NOT NULL")
        again = rows.groupBy("bucket", "dm", "window").agg(F.sum("times").alias("all")).where("all > 1")
        parts = parts.unionByName(rows.where("times = 1").join(again, ["bucket", "dm", "window"]).select("k1", "k2", F.col("lo").alias("s"), (F.col("lo") + length).alias("e")))
    more = parts.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    return whole.join(more, ["k1", "k2"], "full_outer").select("k1", "k2", F.concat(F.coalesce("spans", F.array()), F.coalesce("more", F.array())).alias("spans"))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _kept(keep: tuple[str, ...]):
    names = ["doc_id", *(f"_{c}" for c in keep), "n_bytes", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, at_all = text_buffer(batch["text"])
            for i, j in row_chunks(at_all, 1 << 21):
                part = batch.slice(i, j - i)
                data, at = every[at_all[i] : at_all[j]], at_all[i : j + 1] - at_all[i]
                spans = pc.fill_null(part["spans"], [])
                x = spans.flatten()
                row = np.repeat(np.arange(j - i), pc.list_value_length(spans).to_numpy())
                # a byte between documents keeps spans of neighbours apart
                s, e = (x.field(c).to_numpy() + at[row] + row for c in ("s", "e"))
                by = np.argsort(s, kind="stable")
                s, reach = s[by], np.maximum.accumulate(e[by])
                cut = np.flatnonzero(np.append(True, s[1:] > reach[:-1])) if len(s) else np.zeros(0, np.int64)
                s, e, row = s[cut], reach[np.append(cut[1:], len(reach)) - 1] if len(cut) else reach[:0], row[by][cut]
                s, e = s - row, e - row
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, s, 1)
                np.add.at(edge, e, -1)
                stays = np.cumsum(edge[:-1]) == 0
                offsets = np.concatenate([[0], np.cumsum(stays)])[at].astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(data[stays])])
                merged = pa.StructArray.from_arrays([pa.array((y - at[row]).astype(np.int32)) for y in (s, e)], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), merged)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(part[f"_{c}"] for c in keep), pa.array(np.diff(at)), lists, kept], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal), kept (the bytes that stay) of every document, and columns to keep, named _column."""
    keyed = row_key(docs, keep)
    return keyed.join(repeated_spans(keyed, length, hot), ["k1", "k2"], "left").mapInArrow(lean(_kept(keep)), f"doc_id long{kept_schema(docs, keep)}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
