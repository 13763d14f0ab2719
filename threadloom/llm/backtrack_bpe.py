"""Exact BPE by backtracking, and decoding through an offset table.

An Aho-Corasick automaton over the reversed tokens gives the longest token at every place of a word in
one pass. Tokens are taken greedily, longest first, as long as each is compatible with the one before;
two tokens are compatible if no merge crosses the border between them before both are complete. Where
no token fits, the place is dead and the last token gives way to its next shorter prefix. Compatible
pairs are kept in a table, so a word takes linear time; equal words are encoded once per worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm import pretokens
from threadloom.llm import textkernel as tk
from threadloom.llm.workdir import columns_or_null, small_batches

_WORD_END = "</w>"


class Backtracker:
    """Encodes words by the merges of a BPE vocabulary. A word's last byte is a letter of its own (+256)."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte = {c: chr(b) for b, c in enumerate(pretokens.byte_letters())}

        def own(token: str) -> str:
            ends = token.endswith(_WORD_END)
            letters = [byte[c] for c in (token[: -len(_WORD_END)] if ends else token)]
            return "".join(letters[:-1]) + chr(ord(letters[-1]) + 256 * ends)

        self.text = {i: own(t) for t, i in vocab.items()}
        ids = {t: i for i, t in self.text.items()}
        never = len(merges)
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            whole = ids[self.text[pair[0]] + self.text[pair[1]]]
            self.rank.setdefault(pair, r)
            if whole not in self.halves:
                self.halves[whole], self.born[whole] = pair, r
        self.never = never
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        whole: set[int] = set()  # tokens that encode to themselves
        for t in sorted(self.text, key=lambda t: self.born.get(t, -1)):
            if t not in self.halves:
                if len(self.text[t]) == 1:
                    whole.add(t)
            else:
                a, b = self.halves[t]
                if a in whole and b in whole and not self._crossed(a, b, self.born[t]):
                    whole.add(t)
        self.size = {t: len(self.text[t]) for t in whole}
        by_text = {self.text[t]: t for t in whole}
        self.shorter = {t: next((by_text[s] for n in range(len(x) - 1, 0, -1) if (s := x[:n]) in by_text), None) for x, t in by_text.items()}
        self.automaton = ahocorasick.Automaton()
        for x, t in by_text.items():
            self.automaton.add_word(x[::-1], t)
        self.automaton.make_automaton()
        self.right.clear()
        self.left.clear()

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of `token` while it grows, and the rank that ends each."""
        kept, first = (self.left, self.right)[side], token
        if first in kept:
            return kept[first]
        out, until = kept.setdefault(first, []), self.never
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            until, token = self.born[token], self.halves[token][side]

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank below `before` joins a part of a and a part of b. Of equal ranks the left goes first."""
        for x, x_until in self._spine(a, 1):
            for y, y_until in self._spine(b, 0):
                m = self.rank.get((x, y))
                if m is not None and m < before and m < x_until and m <= y_until:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            found = self.pairs[a, b] = not self._crossed(a, b, 1 << 60)
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of a word given as one character a byte."""
        n = len(word)
        word = word[:-1] + chr(ord(word[-1]) + 256)
        size, shorter = self.size, self.shorter
        longest: list[int | None] = [None] * n
        best = [0] * n
        for end, t in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if size[t] > best[at]:
                best[at], longest[at] = size[t], t
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            while token is not None and (at + size[token] in dead or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else None
            elif out:
                dead.add(at)
                token = out.pop()
                at -= size[token]
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out


class Codec:
    """A tokenizers file with word ends, read as data: normalising, cutting, merging, and the offset table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=lambda x: (-len(x), x))
        self.cuts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None
        tracker = Backtracker(vocab, spec["model"]["merges"])
        self.pieces = pretokens.PieceCache(lambda words: list(map(tracker.encode, words)), "".join(map(chr, range(256))), 200_000)
        shown = {i: t for t, i in (vocab | self.special).items()}
        table = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, letter by letter; white space falls out when pieces are cut."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def segments(self, text: str) -> list[str | int]:
        """The text cut at special tokens, which stand as their ids."""
        return [self.special.get(x, x) for x in self.cuts.split(text)] if self.cuts else [text]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the texts' offsets."""
        parts = [self.segments(t) if "<|" in t else [t] for t in texts]
        flat = [self.normal(x).encode() for p in parts for x in p if isinstance(x, str)]
        raw, offsets = np.frombuffer(b"".join(flat), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
        starts, ends, rows = pretokens.cut(raw, offsets, spaces_join=False)
        ids, lengths = self.pieces.ids(raw, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[rows]
        if len(flat) == len(texts):
            return ids, bounds
        out, k, sizes = [], 0, []
        for p in parts:
            n = 0
            for x in p:
                if isinstance(x, str):
                    out.append(ids[bounds[k] : bounds[k + 1]])
                    k += 1
                else:
                    out.append(np.array([x], ids.dtype))
                n += len(out[-1])
            sizes.append(n)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the ids' tokens with a space between two, by the offset table."""
        ids = ids.astype(np.int64)
        return tk.gather(self.bytes, self.offsets[ids], self.lengths[ids])[: -1 if len(ids) else None]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encoded(path: str, texts_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column("text")
            _, offsets = tk.text_bytes(column)
            for first, last in tk.slices(offsets, 1 << 20):
                ids, bounds = own.encode([t or "" for t in column.slice(first, last - first).to_pylist()])
                wide = ids.astype("<u4")
                rows = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    text = own.decode(ids[a:b]).tobytes()
                    data = wide[a:b].tobytes()
                    rows.append((b - a, data, text.decode()) if texts_out else (b - a, hashlib.sha256(data).hexdigest(), hashlib.sha256(text).hexdigest()))
                names = ["n_tokens", "ids", "decoded"] if texts_out else ["n_tokens", "ids_sha256", "decoded_sha256"]
                n, x, y = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), pa.array(x, pa.binary() if texts_out else pa.string()), pa.array(y, pa.string())], ["doc_id", *names])

    return run


def encode_decode(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every text of docs (doc_id, text); a row for each row.

    ids are little-endian unsigned 32-bit integers; with digests=True the SHA-256 digests (lower-case
    hex) stand in their place. A null or empty text has no ids and decodes to nothing. Null doc_ids
    and repeated rows stay as they are; further columns are left behind. No special tokens are added;
    their strings in a text count as the special tokens. tokenizer: path of a tokenizers file.
    """
    small_batches(docs.sparkSession)
    docs = columns_or_null(docs, doc_id="long", text="string")
    if digests:
        return docs.mapInArrow(_encoded(tokenizer, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.mapInArrow(_encoded(tokenizer, True), "doc_id long, n_tokens long, ids binary, decoded string")
