"""Operator 5: exact Jaccard join of word n-gram sets, as connected components.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A document's set holds its
distinct 5-word shingles; with fewer words, the whole sequence; without words it is empty and linked with
nothing. Two documents link when 100 * |intersection| >= 75 * |union|.

Documents with equal sets form a class; everything below is between classes.

1. An order of all shingles: those that are frequent (counted task by task over all documents, copies once, in slots so many
   that a frequent shingle stands out from its slot at any size) last, then by hash, so that lists don't grow with
   passages that many texts share. A set
   of n can only link with sets that share one of its first n - ceil(3n/4) + 1 shingles: these are indexed, with
   their positions. Index lists are ordered by set size and cut where sizes jump by more than the threshold
   allows. A link's first shared shingle leaves both sets the needed overlap from there on, so entries whose
   position leaves too little are skipped, a block at a time. Lists of one class are dropped, equal ones kept once.
2. Set relations: the sets with one first shingle are compared, in full and in segments, with representatives of those
   seen so far. A set that links takes over the other's answers: it joins its component, and two sets of one component
   are never compared again.
3. What is left is few. In one of EARLY lists, then in all, each set outside the list's largest component is held against
   the likeliest partner in another component, in rounds until one finds no more than FEW_LINKS links: a pair a set and
   list at most, so groups of near copies connect without their pairs being made. Then all pairs of a list that are
   still in different components and that sketches allow are compared, so the result is exact. Lists of more than BLOCK classes are dealt out as pairs of blocks, and blocks
   of the largest component are not paired with each other.

Lists of shingles that are frequent beyond LIST are dealt to several tasks; no task holds such a list.
Before sets are compared in full in step 3, parity sketches are: the bits in which two sketches differ are never more
than the shingles in which the sets differ, so no link is lost. Full sets are made only for what is left,
and shuffled by one side with salts, so that a set with many partners is spread.

Shingles are compared as 64-bit hashes. Null text has no words. Repeated rows are equal sets. A null doc_id
counts as the smallest. Very long texts are worked on whole, one at a time. Empty tables give no rows.
Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, NO_ID, Rolling, components, lean, materialize, mix, row_chunks, small_batches, table, text_buffer, whole_groups, words_of

WORDS, PERCENT = 5, 75
LIST = 1 << 16
BLOCK = 1024
SEGMENT = 256
RIVALS = 6
EARLY = 8
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
KEPT_SLOTS = 1 << 18
FEW_LINKS = 1 << 12
SKETCH = 512
WIDEST = 1 << 13
BLOOM = 1 << 24
BLOOM_IDS = BLOOM // 8
KEPT_CLASSES = 200_000
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(9, 14)]] = False
_SEED = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = LOWER[data]
    s, e, first = words_of(low, at, _IS_WORD)
    words = Rolling(low).at(s, e)
    m = max(len(words) - k + 1, 0)
    grams = np.zeros(m, np.uint64)
    for j in range(k):
        grams += words[j : m + j] * _SEED[j]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.atleast_1d((words[a:b] * _SEED[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A set's class: a hash of its shingles and their number, as a signed long."""
    x = mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64))
    return int(x.view(np.int64)[0])


def sketch_of(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)).tobytes()


def wide_sketch_of(s: np.ndarray) -> bytes:
    """A sketch of the least power of two of bits that is the set's size or more, WIDEST at most; a larger one folds into a smaller."""
    bits = np.uint64(min(max(SKETCH, 1 << (len(s) - 1).bit_length()), WIDEST))
    return np.packbits((np.bincount((s & (bits - np.uint64(1))).astype(np.int64), minlength=int(bits)) & 1).astype(bool), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    if len(a) > len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def slot_of(t: np.ndarray) -> np.ndarray:
    return (t >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Order:
    """The order of shingles: by the counted frequency of their slot (0 unless it stands out), then by hash."""

    def __init__(self, slots: dict[int, int]):
        self.slots, self.counts = np.array(list(slots), np.int32), np.array(list(slots.values()), np.int64)
        self._spread()

    def _spread(self) -> None:
        self.count = np.zeros(SLOTS, np.int32)
        self.count[self.slots] = np.minimum(self.counts, 2**31 - 1)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.slots, self.counts

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.slots, self.counts = state
        self._spread()

    def prefix(self, s: np.ndarray, n: int) -> np.ndarray:
        c = self.count[slot_of(s)]
        rare = s[c == 0]
        if len(rare) >= n:
            return rare[:n]
        often = c > 0
        return np.concatenate([rare, s[often][np.argsort(c[often], kind="stable")[: n - len(rare)]]])

    def salts(self, t: np.ndarray, most: int) -> np.ndarray:
        """Into how many tasks a shingle's list is dealt."""
        return self.count[slot_of(t)] // most + 1


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the shingles of a task's classes, counts of the slots that hold four times the mean and eight at least."""
    total = np.zeros(SLOTS, np.int32)
    seen: set[int] = set()
    held, size = [], 0

    def count() -> None:
        nonlocal size
        np.add(total, np.bincount(slot_of(np.concatenate(held)), minlength=SLOTS), out=total, casting="unsafe")
        held.clear()
        size = 0

    for batch in batches:
        data, at = text_buffer(batch["text"])
        for i, j in row_chunks(at):
            for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                # copies make one entry of a list
                if len(s) and (c := class_of(s)) not in seen:
                    if len(seen) >= KEPT_CLASSES:
                        seen.clear()
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size >= 1 << 20:
                count()
    if held:
        count()
    slots = np.flatnonzero(total >= max(8, 4 * total.mean()))
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total[slots], pa.int64())], ["slot", "n"])


_INDEX = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sketch", pa.binary()), ("wide", pa.binary()), ("tokens", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])
_INDEX_SQL = "bucket int, doc_id long, n long, cls long, sketch binary, wide binary, tokens binary, classes binary, sizes binary, places binary"


def _indexer(order, buckets: int, percent: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, classes, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            t, n = np.concatenate(tokens), np.array([len(x) for x in tokens])
            c, z = np.repeat(np.array(classes, np.int64), n), np.repeat(np.array(sizes, np.int32), n)
            p = np.minimum(np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n), 65535).astype(np.uint16)
            salt = mix(c.view(np.uint64)) % order.value.salts(t, most).astype(np.uint64)
            b = (mix(t + salt) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            t, c, z, p, b = t[by], c[by], z[by], p[by], b[by]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
            rows = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            tokens.clear(), classes.clear(), sizes.clear()
            held = 0
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]].astype(np.int32)), none, none, none, pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary()), *[pa.array([x[i:j].tobytes() for i, j in rows], pa.binary()) for x in (t, c, z, p)]], schema=_INDEX)

        for batch in batches:
            data, at = text_buffer(batch["text"])
            ids = batch["doc_id"].to_pylist()
            rows = []
            for i, j in row_chunks(at):
                for d, s in zip(ids[i:j], shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]), strict=True):
                    c = class_of(s) if len(s) else None
                    rows.append((d, len(s), c, sketch_of(s) if len(s) else None, wide_sketch_of(s) if len(s) and c not in seen else None))
                    if c is not None and c not in seen:
                        if len(seen) >= KEPT_CLASSES:
                            seen.clear()
                        seen.add(c)
                        p = order.value.prefix(s, prefix_size(len(s), percent))
                        tokens.append(p), classes.append(c), sizes.append(len(s))
                        held += len(p)
                        if held >= 1 << 19:
                            yield flush()
            none = pa.nulls(len(rows), pa.binary())
            d, n, c, k, w = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            bucket = (mix(np.arange(len(rows), dtype=np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.binary()), pa.array(w, pa.binary()), none, none, none, none], schema=_INDEX)
        if held:
            yield flush()

    return run


def index_lists(tokens: np.ndarray, classes: np.ndarray, sizes: np.ndarray, places: np.ndarray, percent: int, dealt: np.ndarray) -> tuple[dict[bytes, None], list[tuple[int, bytes]], list[tuple[int, int, bytes]]]:
    """The index lists of two classes and more, as packed classes; chunks (token, classes) of long lists and of those that
    are dealt to several tasks; segments (token, number, classes) of the sets that begin with one token."""
    by = np.lexsort((classes, sizes, tokens))
    t, c, n, p, d = tokens[by], classes[by], sizes[by].astype(np.int64), places[by].astype(np.int64), dealt[by]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    t, c, n, p, d = (x[new] for x in (t, c, n, p, d))
    first = np.flatnonzero(p == 0)
    first = first[np.lexsort((mix(c[first].view(np.uint64) ^ t[first]), t[first]))]
    segments = []
    for i, j in _several(t[first[:]], np.zeros(len(first), bool)):
        for k, x in enumerate(range(i, j, SEGMENT)):
            if j - x > 1:
                segments.append((int(t[first[i]].view(np.int64)), k, c[first[x : min(x + SEGMENT, j)]].tobytes()))
    # what a set's partners in this list leave it to share: at least that with the smallest of them
    head = np.flatnonzero(_ends(t, n, percent, d))
    least = np.maximum(-(-percent * n // 100), np.where(d, 0, n[head][np.cumsum(_ends(t, n, percent, d)) - 1]))
    stays = n - p >= -(-percent * (n + least) // (100 + percent))
    t, c, n, d = (x[stays] for x in (t, c, n, d))
    short: dict[bytes, None] = {}
    long: list[tuple[int, bytes]] = []
    for i, j in _several(t, _ends(t, n, percent, d), d):
        if j - i <= BLOCK and not d[i]:
            short[c[i:j].tobytes()] = None
        else:
            # a part of a cut list has a name of its own
            name = int((t[i] if d[i] else mix(t[i : i + 1] + np.uint64(int(n[i])))[0]).view(np.int64))
            long += [(name, c[x : min(x + BLOCK, j)].tobytes()) for x in range(i, j, BLOCK)]
    return short, long, segments


def _ends(t: np.ndarray, n: np.ndarray, percent: int, dealt: np.ndarray) -> np.ndarray:
    """Where a list begins, or goes on after a jump of sizes."""
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | ((100 * n[:-1] < percent * n[1:]) & ~dealt[1:])
    return new


def _several(t: np.ndarray, begins: np.ndarray, alone: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of two rows and more (one, where alone) of equal t that no mark cuts."""
    new = begins.copy()
    new[:1] = True
    new[1:] |= t[1:] != t[:-1]
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(t))
    wanted = b - a > 1
    if alone is not None and len(a):
        wanted |= alone[a]
    yield from zip(a[wanted].tolist(), b[wanted].tolist(), strict=True)


_LISTED = ["kind", "doc_id", "n", "cls", "sketch", "wide", "rid", "seg", "list"]
_LISTED_SQL = "kind int, doc_id long, n long, cls long, sketch binary, wide binary, rid long, seg int, list binary"
_DOC, _SHORT, _LONG, _FIRST = range(4)


def _lister(order, percent: int, most: int):
    def lists(kind: int, rid, seg, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(packed), 5000):
            n = len(packed[i : i + 5000])
            none, blank = pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
            part = [pa.array(x[i : i + n], k) if x is not None else pa.nulls(n, k) for x, k in ((rid, pa.int64()), (seg, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), none, none, none, blank, blank, *part, pa.array(packed[i : i + n], pa.binary())], _LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket"], 1 << 22):
            docs = t.filter(pa.compute.is_valid(t["n"])).select(["doc_id", "n", "cls", "sketch", "wide"])
            for b in docs.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, _DOC, np.int32)), *b.columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], _LISTED)
            packed = t.filter(pa.compute.is_valid(t["tokens"]))
            if packed.num_rows:
                x = [np.frombuffer(b"".join(packed[name].to_pylist()), kind) for name, kind in (("tokens", "<u8"), ("classes", "<i8"), ("sizes", "<i4"), ("places", "<u2"))]
                dealt = order.value.salts(x[0], most) > 1
                keep = np.flatnonzero(dealt | _again(x[0]))
                short, long, first = index_lists(*[y[keep] for y in x], percent, dealt[keep])
                yield from lists(_SHORT, None, None, list(short))
                yield from lists(_LONG, [r for r, _ in long], None, [y for _, y in long])
                yield from lists(_FIRST, [r for r, _, _ in first], [k for _, k, _ in first], [y for _, _, y in first])

    return run


def _again(t: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    by = np.argsort(t, kind="stable")
    same = t[by][1:] == t[by][:-1]
    out = np.zeros(len(t), bool)
    out[by[1:][same]] = out[by[:-1][same]] = True
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            lists = [np.frombuffer(x, "<i8") for x in part["list"].to_pylist()]
            n = [len(x) for x in lists]
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part[c].to_numpy(), n)) for c in ("rid", "seg")] + [pa.array(np.concatenate(lists))], ["rid", "seg", "cls"])


def _clustered(percent: int):
    """Links of the sets of a segment: each is compared with the latest representatives of up to RIVALS components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps = None, []
        for batch in batches:
            a, b = [], []
            for rid, seg, cls, packed in zip(*[batch[k].to_pylist() for k in ("rid", "seg", "cls", "set")], strict=True):
                if key != (rid, seg):
                    key, reps = (rid, seg), []
                s = np.frombuffer(packed, np.uint64)
                for k, (other, x) in enumerate(reps):
                    if other == cls or _link(s, x, percent):
                        if other != cls:
                            a.append(other), b.append(cls)
                        reps.insert(0, reps.pop(k))
                        break
                else:
                    reps.insert(0, (cls, s))
                    del reps[RIVALS:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    i = np.searchsorted(y, x)
    i[i == len(y)] = 0
    both = int((y[i] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _members(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """cls, n, comp, sketch (as uint64 words) and wide sketch of each list of a batch."""
    at = batch["m"].offsets.to_numpy()
    flat = batch["m"].flatten()
    cls, n, comp = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("cls", "n", "comp"))
    data, _ = text_buffer(flat.field("sketch"))
    sketch = data.reshape(-1, SKETCH // 8).view(np.uint64) if len(data) else np.zeros((0, SKETCH // 64), np.uint64)
    at = at - at[0]
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield cls[i:j], n[i:j], comp[i:j], sketch[i:j], flat.field("wide").slice(i, j - i)


def _may_link(n: int, ns: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and ns shingles, of which `apart` at least differ, can be similar enough."""
    return (100 * np.minimum(n, ns) >= percent * np.maximum(n, ns)) & ((100 + percent) * apart <= (100 - percent) * (n + ns))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate([np.zeros((0, 2), np.int64), *[np.stack([np.broadcast_to(p, q.shape), q], 1) for p, q in zip(a, b, strict=True)]])
    x = np.unique(x, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], ["a", "b"])


def _across(percent: int, likeliest: bool):
    """Pairs of a list whose classes are not connected yet and whose sketches, also the wide ones, allow a link; if
    likeliest, only the nearest partner of each class outside the largest component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, held = [], [], 0
            for cls, n, comp, sketch, wide in _members(batch):
                kinds, inverse, size = np.unique(comp, return_inverse=True, return_counts=True)
                if len(kinds) < 2:
                    continue
                largest = inverse == size.argmax()
                rest = np.flatnonzero(~largest)
                wide = wide.to_pylist()
                for k, x in enumerate(rest):
                    other = np.concatenate([np.flatnonzero(largest), rest[k + 1 :]])
                    other = other[inverse[other] != inverse[x]]
                    apart = np.bitwise_count(sketch[other] ^ sketch[x]).sum(1, dtype=np.int64)
                    ok = _may_link(int(n[x]), n[other], apart, percent)
                    other, apart = other[ok], apart[ok]
                    if likeliest and len(other) > RIVALS:
                        other = other[np.argpartition(apart, RIVALS)[:RIVALS]]
                    apart = np.array([bits_apart(wide[x], wide[y]) for y in other.tolist()], np.int64)
                    ok = _may_link(int(n[x]), n[other], apart, percent)
                    other, apart = other[ok], apart[ok]
                    if likeliest and len(other):
                        other = other[[int(apart.argmin())]]
                    if len(other):
                        y = cls[other]
                        a.append(np.minimum(cls[x], y)), b.append(np.maximum(cls[x], y))
                        held += len(y)
                        if held > 1 << 18:
                            yield _pairs(a, b)
                            a, b, held = [], [], 0
            yield _pairs(a, b)

    return run


def bloom_bits(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column `h` of hashes; gathered as at most BLOOM / 64 words."""
    at = ids.select(F.explode(F.array(F.expr(f"h & {BLOOM - 1}L"), F.expr(f"shiftright(h, 32) & {BLOOM - 1}L"))).alias("p"))
    words = at.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
    bits = np.zeros(BLOOM // 64, np.int64)
    for batch in words.select("w", "m").toArrow().to_batches():
        bits[batch["w"].to_numpy()] = batch["m"].to_numpy()
    return bits.view(np.uint64)


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in (h & (BLOOM - 1), (h >> 32) & (BLOOM - 1)):
        ok &= ((bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return ok


def _sets(bits, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch["text"]
            if bits is not None:
                texts = batch.filter(pa.array(in_bloom(bits.value, batch["h"].to_numpy())))["text"]
            data, at = text_buffer(texts)
            for i, j in row_chunks(at, 1 << 20):
                sets = {class_of(s): s for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words) if len(s)}
                sets = {c: s for c, s in sets.items() if c not in seen}
                seen.update(sets)
                if len(seen) > KEPT_CLASSES:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["cls", "set"])

    return run


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls, set of the wanted classes, and of some others. Their documents are found by a filter of fixed size that is
    broadcast; if they are too many for it, by a join."""
    spark = docs.sparkSession
    ids = wanted.join(classes.select("cls", "first"), "cls").select(F.xxhash64("first").alias("h")).distinct()
    texts = docs.select(F.xxhash64("doc_id").alias("h"), "text")
    if ids.limit(BLOOM_IDS + 1).count() <= BLOOM_IDS:
        found = texts.mapInArrow(lean(_sets(spark.sparkContext.broadcast(bloom_bits(ids)), words)), "cls long, set binary")
    else:
        found = texts.join(ids, "h", "left_semi").mapInArrow(lean(_sets(None, words)), "cls long, set binary")
    return found.groupBy("cls").agg(F.first("set").alias("set"))


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch["n_a"].to_numpy() + batch["n_b"].to_numpy()) * (100 - percent)
            apart = [bits_apart(x, y) for x, y in zip(batch["wide_a"].to_pylist(), batch["wide_b"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * np.array(apart, np.int64) <= n))

    return run


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, salt, kind, cls, s in zip(*[batch[k].to_pylist() for k in ("a", "salt", "kind", "b", "set")], strict=True):
                s = np.frombuffer(s, np.uint64)
                if kind == 0:
                    key, one = (x, salt), s
                elif key == (x, salt) and _link(one, s, percent):
                    a.append(x), b.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that link, by their full sets."""
    of = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
    pairs = materialize(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(_near(percent)), "a long, b long"))
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = materialize(full_sets(docs, classes, wanted, words))
    leaders = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("int").alias("salts"))
    dealt = pairs.join(leaders, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    rows = dealt.join(sets, dealt.b == sets.cls).select("a", "salt", F.lit(1).alias("kind"), "b", "set")
    heads = leaders.join(sets, leaders.a == sets.cls).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "set")
    return materialize(rows.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind").mapInArrow(lean(_compared(percent)), "a long, b long"))


def open_pairs(entries: DataFrame, comps: DataFrame, classes: DataFrame, percent: int, block: int, likeliest: bool) -> DataFrame:
    """a, b: pairs of classes in one list (rid, cls) and different components that sketches allow to link."""
    known = entries.join(comps, entries.cls == comps.node, "left").select("rid", "cls", F.coalesce("comp", "cls").alias("comp"))
    lists = known.groupBy("rid", "comp").agg(F.count("*").alias("k")).groupBy("rid").agg(F.sum("k").alias("total"), F.max(F.struct("k", "comp")).alias("top")).where("top.k < total")
    left = known.join(lists, "rid").join(classes.select("cls", "n", "sketch", "wide"), "cls")
    # blocks of the classes outside the largest component, then of that; every pair of blocks that has one of the former
    few, much = f"cast(ceil((total - top.k) / {block}) AS int)", f"cast(ceil(top.k / {block}) AS int)"
    own = f"CASE WHEN total <= {block} THEN 0 WHEN comp = top.comp THEN {few} + pmod(xxhash64(cls), {much}) ELSE pmod(xxhash64(cls), {few}) END"
    pair = f"""CASE WHEN total <= {block} THEN array(struct(0 AS i, 0 AS j)) WHEN comp = top.comp THEN transform(sequence(0, {few} - 1), i -> struct(i AS i, own AS j))
      ELSE transform(sequence(0, {few} + {much} - 1), j -> struct(least(j, own) AS i, greatest(j, own) AS j)) END"""
    dealt = left.withColumn("own", F.expr(f"cast({own} AS int)")).withColumn("at", F.explode(F.expr(pair)))
    grouped = dealt.groupBy("rid", "at").agg(F.collect_list(F.struct("cls", "n", "comp", "sketch", "wide")).alias("m")).select("m")
    return grouped.mapInArrow(lean(_across(percent, likeliest)), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, most: int = LIST, few: int = FEW_LINKS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slots = docs.select("text").mapInArrow(lean(_frequent), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(KEPT_SLOTS)
    order = spark.sparkContext.broadcast(Order({r["slot"]: r["n"] for r in slots.toLocalIterator()}))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    indexed = materialize(docs.mapInArrow(lean(_indexer(order, buckets, percent, most)), _INDEX_SQL).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_lister(order, percent, most)), _LISTED_SQL))
    rows = indexed.where(F.col("kind") == _DOC).select("doc_id", "n", "cls", "sketch", "wide")
    classes = materialize(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide", ignorenulls=True).alias("wide")))
    # sets that begin alike
    first = indexed.where(F.col("kind") == _FIRST).select("rid", "seg", "list").mapInArrow(lean(_entries), "rid long, seg int, cls long")
    sets = full_sets(docs, classes, first.select("cls").distinct(), words)
    links = first.join(sets, "cls").repartition("rid", "seg").sortWithinPartitions("rid", "seg").mapInArrow(lean(_clustered(percent)), "a long, b long")
    comps = materialize(components(links, sparse=True))
    # what is open in the lists
    short = indexed.where(F.col("kind") == _SHORT).select("list").distinct().select(F.xxhash64("list").alias("rid"), "list")
    lists = short.unionByName(indexed.where(F.col("kind") == _LONG).select("rid", "list")).withColumn("seg", F.lit(0))
    entries = materialize(lists.mapInArrow(lean(_entries), "rid long, seg int, cls long").drop("seg"))

    def joined(some: DataFrame, likeliest: bool) -> tuple[DataFrame, DataFrame]:
        more = compare(docs, classes, open_pairs(some, comps, classes, percent, block, likeliest), words, percent)
        return more, materialize(components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)))

    _, comps = joined(entries.where(F.pmod("rid", F.lit(EARLY)) == 0), True)
    while True:
        # each link connects two components, so this ends
        more, comps = joined(entries, True)
        if more.limit(few + 1).count() <= few:
            break
    _, comps = joined(entries, False)
    named = classes.join(comps, classes.cls == comps.node, "left").select("cls", "first", F.coalesce("comp", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("least"))
    named = named.join(least, "comp").select("cls", "least")
    out = rows.drop("sketch", "wide").join(named, "cls", "left")
    clean = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.withColumn("component", F.coalesce("least", "doc_id")).select(clean("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), clean("component").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
