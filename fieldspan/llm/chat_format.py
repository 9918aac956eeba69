"""Operator 3: chat formatting of typed content parts.

A turn is written as  <|start|>ROLE<|sep|>CONTENT<|end|>\\n  and a conversation is its turns end to end. A
visitor flattens a turn's parts in order: text is escaped, an image, audio or document part becomes one
placeholder and is recorded with its place and the tokens it will take once expanded. The loss mask covers
the text parts of assistant turns, and nothing else.

Escaping is reversible and leaves no control string inside a text: a backslash is doubled, and one is put
behind the first character of each control string. In escaped text a backslash always stands before the
character it protects.

Rows are ordered by turn, equal turns by role and text (nulls first). Null role, null text and null parts
are empty. A null conv_id is a conversation of its own. Repeated rows are repeated turns. Unknown part types
are an error. Empty tables give no rows; columns beside those named are ignored. Rows are formatted where
they are read; a conversation is then read as a stream of sorted turns, so none is ever held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, table

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
# Strings that some model's tokenizer takes as control tokens, and this template's own.
CONTROL = ["<|start|>", "<|sep|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>"]
_SPECIAL = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|start\|>(?P<role>.*?)<\|sep\|>(?P<content>.*?)<\|end\|>\n", re.DOTALL)
_HOLDER = re.compile(r"<\|(?:image|audio|document)\|>")

PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
SPANS = "array<struct<start:int,end:int>>"
ATTACHED = "array<struct<kind:string,ref:string,at:int,tokens:int>>"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn in order and builds its segment."""

    def __init__(self, role: str | None, trained: bool):
        self.out = [START, escape(role or ""), SEP]
        self.size = sum(map(len, self.out))
        self.trained, self.loss, self.attached = trained, [], []

    def visit(self, part: dict) -> None:
        kind = part["type"]
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown part type {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def visit_text(self, part: dict) -> None:
        s = escape(part["text"] or "")
        if self.trained and s:
            self.loss.append({"start": self.size, "end": self.size + len(s)})
        self._put(s)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attached.append({"kind": part["type"], "ref": part["ref"], "at": self.size, "tokens": tokens})
        self._put(f"<|{part['type']}|>")

    def visit_image(self, part: dict) -> None:
        self._attach(part, -(-(part["width"] or 0) // PATCH) * -(-(part["height"] or 0) // PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, int(-(-(part["seconds"] or 0) * AUDIO_RATE // 1)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * PAGE_TOKENS)

    def done(self) -> str:
        self._put(END)
        return "".join(self.out)


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (of the text parts), segment, loss (spans of it), attachments, for rows with
    conv_id, turn, role and parts (or text, as one text part)."""
    if "parts" not in rows.columns:
        null = lambda kind: F.lit(None).cast(kind)
        part = F.struct(F.lit("text").alias("type"), F.col("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
        rows = rows.withColumn("parts", F.array(part).cast(PARTS))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for role, parts in zip(batch["role"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                v = Flatten(role, role == "assistant")
                for p in parts or []:
                    v.visit(p)
                made.append({"text": "".join(p["text"] or "" for p in parts or [] if p["type"] == "text"), "segment": v.done(), "loss": v.loss, "attachments": v.attached})
            out = pa.RecordBatch.from_pylist(made, _MADE)
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["role"], *out.columns], ["conv_id", "turn", "role", *_MADE.names])

    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "parts")
    return rows.mapInArrow(lean(segments), f"conv_id long, turn long, role string, text string, segment string, loss {SPANS}, attachments {ATTACHED}")


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MADE = pa.schema([("text", pa.string()), ("segment", pa.string()), ("loss", _SPAN), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())])))])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of formatted text; placeholders are not text."""
    return [(unescape(m["role"]), unescape(_HOLDER.sub("", m["content"]))) for m in _TURN.finditer(formatted)]


def digest(turns: DataFrame) -> DataFrame:
    """What can be read back from the segments of each conversation, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, done = None, []

        def close() -> None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for conv, segment, loss in zip(batch["conv_id"].to_pylist(), batch["segment"].to_pylist(), batch["loss"].to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(segment[span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), _DIGEST, strict=True)], names)
                done = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), _DIGEST, strict=True)], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), "text")
    return ordered.select("conv_id", "segment", "loss").mapInArrow(lean(read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
SAMPLE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    sample = spark.createDataFrame([(-1, 0, "user", SAMPLE), (-1, 1, "assistant", SAMPLE)], "conv_id long, turn long, role string, text string")
    return digest(format_turns(rows.unionByName(sample)))


_PATTERN = "|".join([r"\\", *(re.sub(r"([|\[\]])", r"\\\1", c) for c in CONTROL)])
OP3_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{SAMPLE}' UNION ALL SELECT -1, 1, 'assistant', '{SAMPLE}'),
e AS (SELECT *, length(regexp_replace(role, '{_PATTERN}', '.\\0', 'g')) + length(regexp_replace(text, '{_PATTERN}', '.\\0', 'g')) + {len(START) + len(SEP) + len(END)} AS n FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
