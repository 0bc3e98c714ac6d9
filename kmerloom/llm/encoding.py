"""Encoding texts with a byte-level BPE vocabulary: distinct words in a trie, each shared prefix encoded once.

The encoding of a prefix is known from its last token: it is the encoding of what stands before that token, and the
token. So each trie node needs only that last token, and a walk from the root finds it from the nodes above: of the
vocabulary's tokens that end at the node, it is the one that stays apart from the last token before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD, CACHED_WORDS = 2048, 300_000
# Fixed value: how this family of vocabularies cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Where the public vocabulary byte_bpe_50k lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> (left, right, rank of the merge)
        for r, m in enumerate(model["merges"]):
            left, right = (raw(t) for t in (m.split(" ") if isinstance(m, str) else m))
            pair, whole = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.rank[pair] = r
            self.merged[pair] = whole
            self.parts.setdefault(whole, (*pair, r))
        self.apart: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(WORDS)
        self.cache: dict[str, list[int]] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the texts of tokens a and b, joined, encode to just [a, b]."""
        known = self.apart.get((a, b))
        if known is None:
            known = self.apart[a, b] = self._stays_apart(a, b)
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at that side while `token` is merged, each with the rank at which it is used up."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            left, right, until = self.parts[token]
            token = right if side else left

    def _stays_apart(self, a: int, b: int) -> bool:
        left, right = self._edge(a, 1), self._edge(b, 0)
        for x, x_until in left:
            for y, y_until in right:
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:  # of equal merges the left one goes first
                    return False
        return True

    def step(self, word: bytes, n: int, last: list[int]) -> tuple[int, int]:
        """The last token (and its length) of the first n bytes of `word`, given those of its shorter prefixes; (-1, 0) if none fits."""
        for k in range(min(n, self.longest), 0, -1):
            t = self.ids.get(word[n - k : n])
            if t is not None and (k == n or last[n - k] >= 0 and self.stays_apart(last[n - k], t)):
                return t, k
        return -1, 0

    def merge_plainly(self, word: bytes) -> list[int]:
        """Merge by merge; for words on which no last token fits."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(out) > 1:
            r, i = min((self.rank.get((out[i], out[i + 1]), 1 << 40), i) for i in range(len(out) - 1))
            if r == 1 << 40:
                break
            out[i : i + 2] = [self.merged[out[i], out[i + 1]]]
        return out

    def _read_back(self, word: bytes, last: list[int], size: list[int]) -> list[int]:
        out, n = [], len(word)
        while n > 0:
            if last[n] < 0:
                return self.merge_plainly(word)
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def learn(self, words: set[str]) -> None:
        """Encode the words into the cache by one walk of their trie."""
        root: dict = {}
        for w in words:
            node, b = root, w.encode()
            if len(b) > LONG_WORD:  # too deep for a trie of its own; the same steps on the word alone
                last, size = [-1], [0]
                for n in range(1, len(b) + 1):
                    t, k = self.step(b, n, last)
                    last.append(t)
                    size.append(k)
                self.cache[w] = self._read_back(b, last, size)
                continue
            for x in b:
                node = node.setdefault(x, {})
            node[-1] = w
        last, size = [-1] * (LONG_WORD + 1), [0] * (LONG_WORD + 1)
        path = bytearray()
        todo = [(root, 0, 0)]
        while todo:
            node, depth, x = todo.pop()
            if depth:
                del path[depth - 1 :]
                path.append(x)
                last[depth], size[depth] = self.step(bytes(path), depth, last)
            for key, below in node.items():
                if key == -1:
                    self.cache[below] = self._read_back(bytes(path), last, size)
                else:
                    todo.append((below, depth + 1, key))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text; none for empty and null ones. Words are taught in groups, so memory stays bounded."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(self.words.findall(text) if text else [])
            held += len(group[-1])
            if held > CACHED_WORDS:
                yield from self._encode_group(group)
                group, held = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> Iterator[list[int]]:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        if len(self.apart) > 4_000_000:
            self.apart.clear()
        self.learn({w for words in group for w in words if w not in self.cache})
        cache = self.cache
        for words in group:
            out: list[int] = []
            for w in words:
                out += cache[w]
            yield out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _ids(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = list(v.encode_all(part.column(part.num_columns - 1).to_pylist()))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*part.schema.names[:-1], "ids"])


def encode(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep` and `ids`, the token ids of the column `text`: one row for each row, without a shuffle.

    Texts are taken as stored; strings that look like special tokens are ordinary text. Empty and null texts give the
    empty list. `ids` must not be among `keep`.
    """
    at = path or default_vocabulary()
    if "ids" in keep:
        raise ValueError("rename the column ids first")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ids ARRAY<INT>"])
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(lambda batches: _ids(at, batches), schema)
