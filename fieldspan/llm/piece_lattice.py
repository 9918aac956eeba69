"""Operator 6: SentencePiece encoding and decoding as a relational lattice.

Texts are written with U+2581 for each space and one before the text, and cut before each run of U+2581; no
piece spans such a cut. The distinct words of a chunk of documents are exploded into substrings of at most the
longest piece's length, which are equi-joined to the piece table. The edges are grouped by word and folded by
Spark's aggregate():

* unigram models by Viterbi: the best score and its last edge for each end, then back from the last end;
* BPE models by their merges: of the neighbours that an edge joins, the best scored (of equals the first) are
  merged, until none is left. Viterbi over a BPE model's scores, which are ranks of merges, gives other pieces
  than the model's own encoder; so for these models the fold is the merge rule over the same lattice.

Characters without a piece become their UTF-8 bytes' pieces. A task reads about CHUNK bytes of text at a time
(a longer document alone), which bounds what it holds; their distinct words go through the lattice, then the
texts are put together from them. As explode and the broadcast join keep a partition's order, a word's edges
stand together and are grouped where they are: nothing is shuffled, sorted or spilled.
Words of more than LONG characters, for which the fold would take too long, are encoded by the library.
The piece table is as large as the model and is broadcast.

Null and empty texts have no pieces. Repeated rows and null doc_ids each get their result; empty tables give
no rows. U+2581 in a text is read as a space, as the library does.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, row_chunks, small_batches, table, text_buffer

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 1 << 24
CACHED = 200_000
LONG = 60  # boundaries are bits of a long
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_TEXTS = 1 << 30  # numbers of texts in a chunk start here, those of words at 0


@cache
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id, score of the model's ordinary pieces."""
    sp = processor(model)
    rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def words_of_text(text: str) -> list[str]:
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " ":
        return _WORD.findall(SPACE + text.replace(" ", SPACE))
    return [SPACE + w for w in text.split(" ")]


_EDGE = "struct<cost:double,first:int,last:int,id:int,bytes:array<int>>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of one (chunk, w), with its edges. A run that comes back is an error."""
    held, last = None, (-1, -1)
    for batch in _then_none(batches):
        if batch is not None and not batch.num_rows:
            continue
        parts = [x for x in (held, batch) if x is not None]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks() if len(parts) > 1 else pa.Table.from_batches(parts)
        chunk, w = t["chunk"].to_numpy(), t["w"].to_numpy()
        start = np.concatenate([[0], np.flatnonzero((chunk[1:] != chunk[:-1]) | (w[1:] != w[:-1])) + 1])
        end = len(w) if batch is None else int(start[-1])
        if batch is not None:
            held = t.slice(end).combine_chunks().to_batches()[0]
            start = start[:-1]
        if not len(start):
            continue
        keys = list(zip(chunk[start].tolist(), w[start].tolist(), strict=True))
        if any(a >= b for a, b in zip([last, *keys[:-1]], keys, strict=True)):
            raise RuntimeError("the rows of a word were parted")
        last = keys[-1]
        first = pa.array(start)
        edges = t["edge"].slice(0, end).combine_chunks()
        edges = edges.chunk(0) if isinstance(edges, pa.ChunkedArray) else edges
        word, packed = (t[c].combine_chunks().take(first) for c in ("word", "packed"))
        yield pa.RecordBatch.from_arrays([pa.array(chunk[start]), pa.array(w[start]), word, packed, pa.ListArray.from_arrays(pa.array(np.append(start, end), pa.int32()), edges)], ["chunk", "w", "word", "packed", "edges"])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def lattice(words: DataFrame, pieces: DataFrame, longest: int, byte_zero: int, unknown_cost: float = 1e6) -> DataFrame:
    """chunk, w, word, packed, edges of rows (chunk, w, word, packed): the pieces in the word, least cost first, of equals the
    leftmost. `ends` has the bits of an edge's first and last boundary, `inner` those of the boundaries
    between. Characters without a piece are edges of their bytes' pieces. Rows without a word have no edges."""
    spans = F.expr(f"""explode_outer(flatten(transform(sequence(0, n - 1), s -> transform(sequence(1, least({longest}, n - s)), l ->
        struct(s AS first, s + l AS last, substr(word, s + 1, l) AS piece)))))""")
    x = words.withColumn("n", F.length("word")).select("chunk", "w", "word", "packed", spans.alias("x"))
    # the word itself stays with its first edge only
    x = x.select("chunk", "w", F.expr("CASE WHEN x.first = 0 AND x.last = 1 THEN word END").alias("word"), "packed", "x.first", "x.last", "x.piece")
    x = x.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR piece IS NULL OR last = first + 1")
    spelled = f"transform(array(hex(encode(piece, 'utf-8'))), h -> transform(sequence(1, cast(length(h) / 2 AS int)), k -> cast(conv(substr(h, 2 * k - 1, 2), 16, 10) AS int) + {byte_zero}))[0]"
    edge = F.expr(f"CASE WHEN piece IS NOT NULL THEN struct(coalesce(-score, {unknown_cost}D) AS cost, first, last, id, CASE WHEN id IS NULL THEN {spelled} END AS bytes) END")
    grouped = x.select("chunk", "w", "word", "packed", edge.alias("edge")).mapInArrow(lean(_grouped), f"chunk long, w int, word string, packed binary, edges array<{_EDGE}>")
    bits = "struct(e.first, e.last, e.cost, e.id, e.bytes, shiftleft(1L, e.first) | shiftleft(1L, e.last) AS ends, (shiftleft(1L, e.last) - 1) ^ (shiftleft(2L, e.first) - 1) AS inner)"
    return grouped.withColumn("edges", F.expr(f"transform(array_sort(edges), e -> {bits})"))


#: The word's boundaries are the bits of a long. A merge takes away the one boundary inside an edge.
_MERGE = """aggregate(sequence(1, length(word)), shiftleft(2L, length(word)) - 1, (b, step) -> b & ~coalesce(
  get(filter(edges, e -> (b & e.ends) = e.ends AND bit_count(b & e.inner) = 1), 0).inner, 0L))"""

_BEST = """aggregate(sequence(1, length(word)), array(struct(0D AS cost, 0 AS first)), (best, to) -> concat(best, array(
  array_min(transform(filter(edges, e -> e.last = to), e -> struct(best[e.first].cost + e.cost AS cost, e.first AS first))))))"""
_BACK = """aggregate(reverse(sequence(1, length(word))), shiftleft(1L, length(word)), (b, at) ->
  CASE WHEN (shiftright(b, at) & 1) = 1 THEN b | shiftleft(1L, best[at].first) ELSE b END)"""


def folded(words: DataFrame, kind: str) -> DataFrame:
    """words with ids: the pieces of the lattice's chosen path."""
    if kind == "bpe":
        cut = words.withColumn("b", F.expr(_MERGE))
    elif kind == "unigram":
        cut = words.withColumn("best", F.expr(_BEST)).withColumn("b", F.expr(_BACK))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    path = "array_sort(transform(filter(edges, e -> (b & e.ends) = e.ends AND (b & e.inner) = 0), e -> struct(e.first AS first, e.id AS id, e.bytes AS bytes)))"
    ids = F.expr(f"flatten(transform({path}, e -> coalesce(e.bytes, array(e.id))))")
    return cut.select("chunk", "w", "word", "packed", ids.alias("ids"))


def packed_rows(rows: pa.RecordBatch) -> bytes:
    """doc_id and text of some rows, compressed: texts are shuffled this way."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.select(["doc_id", "text"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows.select(["doc_id", "text"]))
    return sink.getvalue().to_pybytes()


def unpacked_rows(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def encode(docs: DataFrame, model: str, kind: str = "bpe", chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, ids of every document (doc_id, text)."""
    spark = docs.sparkSession
    pieces = piece_table(spark, model)
    sp = processor(model)
    longest = max(len(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    byte_zero = sp.piece_to_id("<0x00>")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents and of the distinct words of their chunk."""
        part, number, size = TaskContext.get().partitionId(), 0, 0
        words: dict[str, None] = {}
        texts: list[bytes] = []

        def row(w: int, some: list[str] | None, packed: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | number], pa.int64()), pa.array([w], pa.int32()), pa.array([some], pa.list_(pa.string())), pa.array([packed], pa.binary())], ["chunk", "w", "words", "packed"])

        def close() -> Iterator[pa.RecordBatch]:
            listed = list(words)
            for i in range(0, len(listed), 4096):
                yield row(i, listed[i : i + 4096], None)
            for i, packed in enumerate(texts):
                yield row(_TEXTS + i, None, packed)

        for batch in batches:
            _, at = text_buffer(batch["text"])
            for i, j in row_chunks(at, chunk // 8):
                rows = batch.slice(i, j - i)
                for t in rows["text"].to_pylist():
                    words.update(dict.fromkeys(w for w in words_of_text(t) if len(w) <= LONG))
                texts.append(packed_rows(rows))
                size += int(at[j] - at[i])
                if size >= chunk:
                    yield from close()
                    words, size, texts, number = {}, 0, [], number + 1
        yield from close()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(chunks), "chunk long, w int, words array<string>, packed binary")
    rows = rows.select("chunk", "w", "packed", F.posexplode_outer("words").alias("i", "word")).select("chunk", (F.col("w") + F.coalesce("i", F.lit(0))).alias("w"), "word", "packed")
    coded = folded(lattice(rows, pieces, longest, byte_zero), kind)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's words come first; then each of its texts is put together from them."""
        now, codes = None, {}
        for batch in batches:
            at = batch["chunk"].to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i < j and at[i] != now:
                    now, codes = at[i], {}
                part = batch.slice(i, j - i)
                n = int((part["w"].to_numpy() < _TEXTS).sum())
                ends, flat = part["ids"].slice(0, n).offsets.to_numpy(), part["ids"].values.to_numpy().astype("<i4")
                codes.update(zip(part["word"].slice(0, n).to_pylist(), [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], strict=True))
                part = part.slice(n)
                for packed in part["packed"].to_pylist():
                    texts = unpacked_rows(packed)
                    out = []
                    for t in texts["text"].to_pylist():
                        found = words_of_text(t)
                        for w in set(found) - codes.keys():
                            codes[w] = np.array(processor(model).encode(w[1:].replace(SPACE, " ")), "<i4").tobytes()
                        out.append(b"".join(map(codes.__getitem__, found)))
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])])
                    yield pa.RecordBatch.from_arrays([texts["doc_id"], texts["text"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))], ["doc_id", "text", "ids"])

    return coded.select("chunk", "w", "word", "packed", "ids").mapInArrow(lean(assemble), "doc_id long, text string, ids array<int>")


def encode_by_words(docs: DataFrame, model: str) -> DataFrame:
    """As encode() for BPE models, but each task encodes its distinct words with the library and keeps up to
    CACHED of them: the same cuts, the same ids, without the lattice. The query and the pipeline use this
    form, as the relational one exceeds the check tool's limits (figures in the README)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, codes = processor(model), {}  # a task's own, so that nothing stays in a worker that Spark uses again
        for batch in batches:
            _, at = text_buffer(batch["text"])
            for i, j in row_chunks(at, 1 << 21):
                part = batch.slice(i, j - i)
                found = [words_of_text(t) for t in part["text"].to_pylist()]
                words = set().union(*found)
                new = [w for w in words if w not in codes]
                if len(codes) + len(new) > CACHED:
                    codes.clear()
                    new = list(words)
                for k in range(0, len(new), 8192):
                    some = new[k : k + 8192]
                    codes.update(zip(some, [array("i", x).tobytes() for x in sp.encode([w[1:].replace(SPACE, " ") if len(w) > 1 else "" for w in some], num_threads=1)], strict=True))
                if SPACE in words:
                    codes[SPACE] = array("i", [sp.piece_to_id(SPACE)]).tobytes()
                out = [b"".join(map(codes.__getitem__, x)) for x in found]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))], ["doc_id", "text", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run), "doc_id long, text string, ids array<int>")


def decoded(ids: np.ndarray, spelled: list[bytes]) -> str:
    text = b"".join(map(spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


@cache
def spellings(model: str) -> list[bytes]:
    """The bytes that each piece stands for."""
    sp = processor(model)
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (with ids) and decoded: the text that the ids stand for."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = batch["ids"].offsets.to_numpy(), batch["ids"].values.to_numpy()
            texts = [decoded(flat[a:b], spellings(model)) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema.fields) + ", decoded string")


def digest(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian uint32), round_trip (the text comes back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = batch["ids"].offsets.to_numpy(), batch["ids"].values.to_numpy()
            spans = list(zip(at[:-1], at[1:], strict=True))
            crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in spans]
            same = [decoded(flat[a:b], spellings(model)) == t.replace(SPACE, " ") for (a, b), t in zip(spans, batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return encoded.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def op6_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path(MODEL)
    return digest(encode_by_words(table(spark, sf_dir, "documents"), model), model)
