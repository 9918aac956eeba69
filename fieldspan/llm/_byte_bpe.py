"""Encoding of whole texts with a public byte-level BPE, each distinct word once.

The pre-tokenizer never joins what stands before a space to what stands behind it unless the space lies
in a longer run of white space, and a line feed between other characters than white space stands alone. So a text
may be cut there, its distinct words encoded by the library, and the text put together from them; tests hold the
result against the library's own encoding of the whole text. Cutting, finding the distinct words and putting together
work on Arrow columns; texts with runs of white space are cut one by one."""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import row_chunks, text_buffer

TOKENIZER = "byte_bpe_50k.json"
CACHED_WORDS = 1_500_000
CHUNK = 1 << 22
#: Stands before a word that no space stands before.
_JOINED = "\x01"
_RUN = re.compile(r"\s \s|\s $")
_CUT = re.compile(r"(?<=\S)(?= )")
_PLAIN = re.compile(r" ?\S+")
#: Unicode's white space and the separators that Python counts among it, as one class of a regular expression.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that are cut one by one: runs that take in a space or a line feed.
_BY_ITSELF = rf"{_SPACE} {_SPACE}|{_SPACE} $|{_SPACE}\n|\n{_SPACE}"


#: How the vocabulary writes bytes, as the published byte-level scheme has it: printable ones of Latin-1 as
#: themselves, the others in order from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Known:
    """Words and their ids, as Arrow and numpy columns: some 25 bytes a word and four an id. Begins anew beyond CACHED_WORDS."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, words: pa.Array, encode) -> np.ndarray:
        """The places of distinct words; encode gives the ids of a list of those that aren't known."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        if len(new) and len(self.words) + len(new) > CACHED_WORDS:
            self._clear()
            at, new = pa.nulls(len(words), pa.int32()), words
        out = at.to_numpy(zero_copy_only=False)
        if len(new):
            out = np.where(np.isnan(out.astype(float)), len(self.words) + np.cumsum(pc.is_null(at).to_numpy(zero_copy_only=False)) - 1, out)
            ids = encode(new.to_pylist())
            size = np.array([len(b) >> 2 for b in ids], np.int64)
            self.words = pa.concat_arrays([self.words, new])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        return out.astype(np.int64)


class WordEncoder:
    """Ids of texts as uint32; no special tokens are put around them. The vocabulary's added tokens that stand in a
    text get their own ids, as by the library's default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        from pathlib import Path

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = json.loads(Path(path).read_text())["added_tokens"]
        if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in what is around them are not supported")
        # the library cuts a text at these first, the longest where several begin
        self.tokens = sorted((t["content"] for t in tokens), key=lambda t: -len(t))
        self.added = re.compile("(" + "|".join(map(re.escape, self.tokens)) + ")") if tokens else None
        self.known = Known()
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {}
        self.feed = int(np.frombuffer(self._whole(["\n"])[0], np.uint32)[0])

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _several(self, words: list[str]) -> list[bytes]:
        """Words without white space inside, by one call: line feeds between them stay apart and mark where each ends."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == self.feed)
        if len(cut) != len(words) - 1:
            return self._whole(words)
        data, at = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
        ends = [*(4 * cut).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(at, ends, strict=True)]

    def _letters(self, w: str) -> bytes | None:
        """The ids of letters, with a space before and marks behind or without: the pre-tokenizer leaves the letters whole, so the
        model is asked directly. None for any other word."""
        core = w[1:] if w[:1] == " " else w
        if core.isalpha():
            if core.isascii():
                shown = w if core is w else "\u0120" + core
            elif max(core) < "\u2000":
                shown = w.encode().decode("latin-1").translate(_SHOWN)
            else:
                return None
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        head = w.rstrip(string.punctuation)
        if len(head) == len(w) or not head[-1:].isalpha():
            return None
        ids, tail = self._letters(head), w[len(head) :]
        if ids is not None and tail not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[tail] = self._whole([tail])[0]
        return None if ids is None else ids + self.marks[tail]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        out = [self._letters(w) for w in words]
        plain, hard = [], []
        for i, w in enumerate(words):
            if out[i] is None:
                (plain if _PLAIN.fullmatch(w) and not (self.added and self.added.search(w)) else hard).append(i)
        for some, by in ((plain, self._several), (hard, self._whole)):
            for k in range(0, len(some), 4096):
                for i, b in zip(some[k : k + 4096], by([words[i] for i in some[k : k + 4096]]), strict=True):
                    out[i] = b
        return out

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has, and the ids end to end. A word begins with _JOINED, or else a space is before it."""
        coded = words.dictionary_encode()
        found = self.known.find(coded.dictionary, lambda new: self._encoded([w[1:] if w[:1] == _JOINED else " " + w for w in new]))
        which = found[coded.indices.to_numpy()]
        n = self.known.size[which]
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.known.begin[which] - (ends - n), n)
        return n, self.known.flat[place]

    @staticmethod
    def pieces(text: str) -> list[str]:
        if _RUN.search(text):
            return _CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _split(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.pieces(text) if text else []
        # every other part is an added token, which stays whole and goes to the library
        parts = self.added.split(text)
        return [w for i, p in enumerate(parts) if p for w in ([p] if i % 2 else self.pieces(p))]

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (one more entry than texts), and all ids. The texts should hold a few MB together."""
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        alone = pc.match_substring_regex(texts, _BY_ITSELF)
        for token in (*self.tokens, _JOINED):
            alone = pc.or_(alone, pc.match_substring(texts, token))
        mark = alone.to_numpy(zero_copy_only=False)
        n, ids = np.zeros(len(texts), np.int64), []
        if not mark.all():
            # a line feed becomes a word
            rows = pc.binary_join_element_wise(_JOINED, pc.replace_substring(texts.filter(pc.invert(alone)), "\n", f" {_JOINED}\n {_JOINED}"), "")
            words = pc.split_pattern(rows, " ")
            size, some = self._ids(words.flatten())
            n[~mark] = np.diff(np.concatenate([[0], np.cumsum(size)])[words.offsets.to_numpy()])
            ids.append(some)
        if mark.any():
            cut = [None if _JOINED in t else [w[1:] if w[0] == " " else _JOINED + w for w in self._split(t)] for t in texts.filter(alone).to_pylist()]
            size, some = self._ids(pa.array([w for t in cut for w in t or ()], pa.string()))
            ends, flat = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(t or ()) for t in cut])])], some
            parts = [flat[a:b] if t is not None else None for t, a, b in zip(cut, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for k in [k for k, t in enumerate(cut) if t is None]:
                parts[k] = np.frombuffer(self._whole([texts[int(np.flatnonzero(mark)[k])].as_py()])[0], np.uint32)
            n[mark] = [len(p) for p in parts]
            ids.append(np.concatenate(parts))
        offsets = np.concatenate([[0], np.cumsum(n)])
        if len(ids) == 1:
            return offsets, ids[0]
        of = np.repeat(mark, n)
        out = np.empty(int(offsets[-1]), np.uint32)
        out[~of], out[of] = ids
        return offsets, out

    def batches(self, texts: pa.Array):
        """i, j, offsets and ids of the texts i to j, a few MB at a time. Null texts are empty."""
        texts = pc.fill_null(texts, "")
        _, at = text_buffer(texts)
        for i, j in row_chunks(at, CHUNK):
            yield i, j, *self.ids_of(texts.slice(i, j - i))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The process's encoder of a vocabulary file; Spark reuses Python workers, and so its cache."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
