"""Operator 9: token ids in seekable binary files.

A file is a run of independent zstandard frames, each of whole documents, then a skippable frame with
the seek table, which ends the file:

    frame     zstandard of: uint32 documents n | n x (int64 doc_id, uint8 is_null, uint32 ids) | ids (uint32)
    seek      0x184D2A5E, uint32 bytes that follow | per frame: uint32 compressed, uint32 raw, uint32 crc32 of
              the raw bytes, int64 first and last doc_id | uint32 frames, uint64 ids in the file, uint32 magic

All numbers are little-endian. A reader takes the seek table from the end of the file and decompresses only
the frames whose doc_id range meets its request; every frame read is checked against its crc32. Files are written by
Spark's text sink, and so by its committer: a lost executor or a second attempt leaves no half-written file behind, on
any store. That sink puts a line feed behind a file's only row; it is the last byte of the seek table's magic number.

Null text is empty (the end id alone). Null doc_ids are kept, sorted first. Repeated doc_ids are ordered by
text, and each has a row. An empty table gives no file and no row. Very long documents get a frame alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._byte_bpe import TOKENIZER, encoder
from ._common import NO_ID, estimated_bytes, lean, materialize, shared_dir, small_batches, table

END_ID = 2
SEEK_MAGIC, FOOT_MAGIC = 0x184D2A5E, 0x0A544B46
_ENTRY, _FOOT, _DOC = struct.Struct("<IIIqq"), struct.Struct("<IQI"), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])


def pack_frame(ids: list[int | None], blobs: list[bytes], level: int = 1) -> tuple[bytes, bytes, int]:
    """The frame, its entry of the seek table and how many ids it holds."""
    head = np.zeros(len(ids), _DOC)
    head["id"] = [NO_ID if x is None else x for x in ids]
    head["null"] = [x is None for x in ids]
    head["n"] = [len(b) // 4 for b in blobs]
    raw = struct.pack("<I", len(ids)) + head.tobytes() + b"".join(blobs)
    frame = zstandard.ZstdCompressor(level=level).compress(raw)
    return frame, _ENTRY.pack(len(frame), len(raw), zlib.crc32(raw), int(head["id"][0]), int(head["id"][-1])), int(head["n"].sum(dtype=np.int64))


def close_file(frames: list[bytes], entries: list[bytes], n_ids: int) -> bytes:
    table_ = b"".join(entries) + _FOOT.pack(len(entries), n_ids, FOOT_MAGIC)
    return b"".join([*frames, struct.pack("<II", SEEK_MAGIC, len(table_)), table_])


def seek_table(tail: bytes) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Entries and number of ids, from the last bytes of a file (all of it will do)."""
    n, ids, magic = _FOOT.unpack(tail[-_FOOT.size :])
    if magic != FOOT_MAGIC:
        raise ValueError("no seek table")
    at = len(tail) - _FOOT.size - n * _ENTRY.size
    return [_ENTRY.unpack_from(tail, at + i * _ENTRY.size) for i in range(n)], ids


def read_frame(frame: bytes, entry: tuple[int, int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(frame, max_output_size=entry[1])
    if len(raw) != entry[1] or zlib.crc32(raw) != entry[2]:
        raise ValueError("a frame is damaged")
    (n,) = struct.unpack_from("<I", raw)
    head = np.frombuffer(raw, _DOC, n, 4)
    return head, np.frombuffer(raw, "<u4", offset=4 + n * _DOC.itemsize)


def read_documents(content: bytes, wanted: set[int]) -> dict[int, np.ndarray]:
    """The ids of the wanted documents; only frames that may hold one are decompressed."""
    entries, _ = seek_table(content)
    out, at = {}, 0
    for e in entries:
        if any(e[3] <= x <= e[4] for x in wanted):
            head, ids = read_frame(content[at : at + e[0]], e)
            ends = np.cumsum(head["n"], dtype=np.int64)
            out |= {int(h["id"]): ids[end - h["n"] : end] for h, end in zip(head, ends, strict=True) if not h["null"] and int(h["id"]) in wanted}
        at += e[0]
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, frame_bytes: int = 1 << 18, file_bytes: int = 1 << 24, text: str = "text") -> None:
    """Encodes docs (doc_id, text) and writes files of about file_bytes of frames in ascending doc_id order.

    One range shuffle of the texts, into as many partitions as the planner's size of docs asks for; files never hold more
    than a range partition, and no task more than one file and the batch it reads."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = struct.pack("<I", end_id)
        frames, entries, n_ids, size, first = [], [], 0, 0, 0
        ids, blobs, held = [], [], 0

        def flush() -> None:
            nonlocal n_ids, size, held
            if ids:
                frame, entry, n = pack_frame(ids, blobs)
                frames.append(frame)
                entries.append(entry)
                n_ids, size, held = n_ids + n, size + len(frame), 0
                ids.clear()
                blobs.clear()

        def out() -> pa.RecordBatch:
            nonlocal n_ids, size
            content = close_file(frames, entries, n_ids).removesuffix(b"\n")  # the sink writes it
            frames.clear()
            entries.clear()
            n_ids, size = 0, 0
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for i, j, at, found in enc.batches(batch["text"]):
                data = found.tobytes()
                for d, a, b in zip(doc_ids[i:j], (4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True):
                    ids.append(d)
                    blobs.append(data[a:b] + end)
                    held += b - a + 4
                    if held >= frame_bytes:
                        flush()
                        if size >= file_bytes:
                            yield out()
        flush()
        if frames:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(docs) // (8 * file_bytes)))
    files_ = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.col("text")).mapInArrow(lean(files), "content binary")
    # a task that makes several files writes them one to a part: maxRecordsPerFile
    files_.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, file, file_first, file_ids, at (ids before it in its file), n_tokens, ids_crc32, ids (null unless with_ids): every document of the files."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                content = content.as_py()
                entries, n_ids = seek_table(content)
                at, before = 0, 0
                for e in entries:
                    head, ids = read_frame(content[at : at + e[0]], e)
                    ends = np.cumsum(head["n"], dtype=np.int64)
                    starts = ends - head["n"]
                    raw = ids.view(np.uint8)
                    crc = [zlib.crc32(raw[4 * s : 4 * t]) for s, t in zip(starts, ends, strict=True)]
                    n = len(head)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(head["id"].astype(np.int64), mask=head["null"].astype(bool)), pa.array([name.as_py()] * n), pa.array([entries[0][3]] * n, pa.int64()), pa.array([n_ids] * n, pa.int64()), pa.array(before + starts), pa.array(head["n"].astype(np.int64)), pa.array(crc, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int64))) if with_ids else pa.nulls(n, pa.list_(pa.int64()))],
                        ["doc_id", "file", "file_first", "file_ids", "at", "n_tokens", "ids_crc32", "ids"],
                    )
                    at, before = at + e[0], before + int(ends[-1])

    schema = "doc_id long, file string, file_first long, file_ids long, at long, n_tokens long, ids_crc32 long, ids array<long>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lean(docs), schema)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_token_files(docs, path, tokenizer, end_id)
    rows = materialize(read_token_files(spark, path, False).drop("ids"))
    # one row a file: their running totals are the files' places in the whole
    files = rows.select("file", "file_first", "file_ids").distinct()
    order = Window.orderBy("file_first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("file_ids").over(order), F.lit(0))).select("file", "before")
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
