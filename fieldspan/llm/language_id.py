"""Operator 1: language identification of mixed-language text.

A word is a run of letters. Its script (by code-point ranges) leaves the languages that were seen in that
script; each of these scores the word by its character trigrams, and Viterbi with a penalty for each switch
labels the words, which gives spans of one language. A text's language is the one with most letters; its
score is that language's share of all letters.

The model is fitted on at most about ROWS labelled rows a language (an expected bound: rows are taken by a
hash of doc_id and text), whole texts each, of the LANGS languages with most rows; trigram counts are summed in Spark into SLOTS slots a language, which
bounds what reaches the driver. Words in a script that no language was seen in are left unlabelled. A text
with letters but no labelled word gets the language most rows have, with score 0. Null text and text without
letters: 'und', score 0. Without labelled rows nothing is learned and every text is 'und'. Repeated rows and
null doc_ids each get their result; empty tables give no rows; other columns are ignored. Very long texts are
scored in pieces of whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, mix, row_chunks, small_batches, table, text_buffer

ROWS = 4000
LANGS = 250  # labels are bytes
SLOTS = 1 << 16
PENALTY = 8.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01
# First and last code points of scripts' main blocks.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0x2C60, 0x2C7F), ("Latin", 0xA720, 0xA7FF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Cyrillic", 0x1C80, 0x1C8F), ("Cyrillic", 0x2DE0, 0x2DFF), ("Cyrillic", 0xA640, 0xA69F),
    ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Arabic", 0x8A0, 0x8FF), ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFF),
    ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F),
    ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF),
    ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x3134F),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case where that is one character, its script."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            low = x.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    script = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


class Words:
    """The words of texts: code points of all letters, their trigrams' slots, where words begin."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        letter, lower, script = _characters()
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        inside = letter[chars]
        follows = np.zeros(len(chars), bool)  # whether the character before is of the same word
        follows[1:] = inside[1:] & inside[:-1]
        edges = ends[:-1][ends[:-1] < len(chars)]
        follows[edges] = False
        at = np.flatnonzero(inside)
        low = lower[chars[at]].astype(np.uint64)
        joined = follows[at]
        before, after = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        before[1:][joined[1:]] = low[:-1][joined[1:]]
        after[:-1][joined[1:]] = low[1:][joined[1:]]
        self.slots = (mix((before << np.uint64(42)) | (low << np.uint64(21)) | after) >> np.uint64(48)).astype(np.int64)
        self.first = np.flatnonzero(~joined)  # places of first letters among the letters
        self.letters = np.diff(np.append(self.first, len(at)))
        self.start = at[self.first]
        self.script = script[chars[self.start]]
        self.row = np.searchsorted(ends, self.start, side="right")
        self.start = self.start - (ends - lengths)[self.row]


def _texts(column, most: int = 1 << 19) -> Iterator[tuple[int, int, Words]]:
    column = pc.fill_null(column, "")
    data, at = text_buffer(column)
    lengths = pc.utf8_length(column).to_numpy().astype(np.int64)
    for i, j in row_chunks(at, most):
        yield i, j, Words(data[at[i] : at[j]], lengths[i:j])


class Model:
    def __init__(self, langs: list[str], rows: list[int], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.common = int(np.argmax(rows)) if rows else 0
        total = grams.sum(1, keepdims=True)
        self.table = np.log((grams + SMOOTHING) / (total + SMOOTHING * SLOTS)).T.astype(np.float32).copy()
        seen = scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE
        self.allowed = seen.T.copy()  # by script and language

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's score in each language, and whether any language may have it."""
        out = np.add.reduceat(self.table[words.slots], words.first, axis=0) if len(words.first) else np.zeros((0, len(self.langs)), np.float32)
        ok = self.allowed[words.script]
        known = ok.any(1)
        out[~ok] = -1e9
        out[~known] = 0
        return out, known


def viterbi(scores: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word. count: words of each text, end to end in scores. All texts step together."""
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    n, begin = count[order], first[order]
    n_langs = scores.shape[1]
    back = np.zeros(scores.shape, np.uint8)
    label = np.zeros(len(scores), np.uint8)
    if not len(scores):
        return label
    live = int((n > 0).sum())
    best = scores[begin[:live]].astype(np.float64)
    own = np.arange(n_langs, dtype=np.uint8)[None]
    active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 2), side="right")  # texts with at least t words
    for t in range(1, int(n[0])):
        k = active[t]
        x = best[:k]
        arg = x.argmax(1)
        top = x[np.arange(k), arg] - penalty
        switch = top[:, None] > x
        at = begin[:k] + t
        back[at] = np.where(switch, arg[:, None].astype(np.uint8), own)
        np.copyto(x, top[:, None], where=switch)
        x += scores[at]
    now = best.argmax(1).astype(np.uint8)
    for t in range(int(n[0]) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        label[at] = now[:k]
        now[:k] = back[at, now[:k]] if t else now[:k]
    return label


def fit(docs: DataFrame, labelled: Column, rows: int = ROWS) -> Model:
    """A model from the rows of docs (doc_id, text, lang) for which labelled holds."""
    known = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    have = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    langs = sorted(have)
    if not langs:
        return Model([], [], np.zeros((0, SLOTS)), np.zeros((0, len(SCRIPT_NAMES))))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows / have[k]))]), F.col("lang"))
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([langs.index(x) for x in batch["lang"].to_pylist()])
            total = np.zeros((len(langs), SLOTS + len(SCRIPT_NAMES)), np.int64)
            for i, _, words in _texts(batch["text"]):
                lang = of[i + words.row]
                for k in np.unique(lang):
                    mine = lang == k
                    total[k, :SLOTS] += np.bincount(words.slots[np.repeat(mine, words.letters)], minlength=SLOTS)
                    total[k, SLOTS:] += np.bincount(words.script[mine], words.letters[mine], minlength=len(SCRIPT_NAMES)).astype(np.int64)
            k, slot = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[k, slot])], ["lang", "slot", "n"])

    total = np.zeros((len(langs), SLOTS + len(SCRIPT_NAMES)))
    for b in sample.mapInArrow(lean(count), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        total[b["lang"].to_numpy(), b["slot"].to_numpy()] = b["n"].to_numpy()
    return Model(langs, [have[k] for k in langs], total[:, :SLOTS], total[:, SLOTS:])


SPANS = "array<struct<start:int,end:int,lang:string>>"


def _spans(words: Words, label: np.ndarray, known: np.ndarray, rows: int, langs: list[str]) -> pa.Array:
    """Runs of words of one language, in characters; unlabelled words belong to no run and end none."""
    w = np.flatnonzero(known)
    row, lab = words.row[w], label[w]
    new = np.ones(len(w), bool)
    new[1:] = (row[1:] != row[:-1]) | (lab[1:] != lab[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(w))[: len(a)] - 1
    values = pa.StructArray.from_arrays([pa.array(words.start[w[a]], pa.int32()), pa.array(words.start[w[b]] + words.letters[w[b]], pa.int32()), pa.DictionaryArray.from_arrays(pa.array(lab[a], pa.int32()), pa.array(langs, pa.string())).cast(pa.string())], ["start", "end", "lang"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[a], np.arange(rows + 1)), pa.int32()), values)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score and lang_spans (characters from, to, language)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans")]
    docs = docs.select(*names)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, words in _texts(batch["text"]):
                n = j - i
                part = batch.slice(i, n)
                if not m.langs:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(["und"] * n), pa.array([0.0] * n), pa.array([[]] * n, pa.list_(_SPAN))], [*names, "lang_pred", "score", "lang_spans"])
                    continue
                scores, known = m.scores(words)
                best = viterbi(scores, np.bincount(words.row, minlength=n), penalty)
                share = np.zeros((n, len(m.langs)))
                np.add.at(share, (words.row[known], best[known]), words.letters[known])
                letters = np.bincount(words.row, words.letters, minlength=n)
                top = share.argmax(1)
                score = share[np.arange(n), top] / np.maximum(letters, 1)
                top[share.max(1) == 0] = m.common
                pred = np.where(letters > 0, np.array(m.langs, object)[top], "und")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred.tolist(), pa.string()), pa.array(score), _spans(words, best, known, n, m.langs)], [*names, "lang_pred", "score", "lang_spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(label), f"{kinds}, lang_pred string, score double, lang_spans {SPANS}")


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
