"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word there is one last token of its encoding. The matches of the vocabulary that end at the
prefix come from an automaton over the vocabulary with suffix links (each state knows the tokens that are suffixes of
what was read); a match is the last token if it fits the last token of the prefix before it, that is if no merge
across their border would have come earlier than the merges that built them. The chosen tokens are stored per prefix,
and back-pointers from the end give the ids. Time is linear in the text, whatever the word's length; no merge loop
runs over the text.

Words are cut by the vocabulary's public pattern. Each distinct word is encoded once per worker. Strings that spell
special tokens are ordinary text. Null and empty texts have no ids: an empty list.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veriloom.session import balanced

#: Fixed value: the public cutting pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker before the store starts anew.
_MOST_WORDS = 300_000


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens in the order of their ids, from lines of 'base64 id'."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Encoder:
    """tokens: the vocabulary in merge order, single bytes first."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.cutter = regex.compile(pattern)
        n = len(tokens)
        self.size = n
        ids = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.left, self.right = list(range(n)), list(range(n))
        self.joined: dict[tuple[int, int], int] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            if len(t) > 1:
                # The last merge that built the token is its one cut into two earlier tokens that fit side by side.
                for k in range(1, len(t)):
                    a, b = ids.get(t[:k], n), ids.get(t[k:], n)
                    if a < i and b < i and self._fit(a, b):
                        self.left[i], self.right[i] = a, b
                        self.joined[a, b] = i
                        break
                else:
                    continue  # never the result of a merge
            machine.add_word(t.decode("latin-1"), i)
        machine.make_automaton()
        self.machine = machine
        self.fitting.clear()

    def _fit(self, a: int, b: int) -> bool:
        """True if token a followed by token b stays so: no merge across the border comes before those within."""
        left, right, joined = self.left, self.right, self.joined
        earliest = self.size + 1
        while True:
            across = joined.get((a, b))
            if across is not None and across < earliest:
                return False
            # Take back the later of the two last merges; of equal ones the right one, as merges run from the left.
            inner_a, inner_b = right[a], left[b]
            if a > b and inner_a != a:
                earliest, a = a, inner_a
            elif inner_b != b:
                earliest, b = b + 1, inner_b
            elif inner_a != a:
                earliest, a = a, inner_a
            else:
                return True

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        known = self.words.get(word)
        if known is not None:
            return known
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        lengths, fitting = self.lengths, self.fitting
        last = [-1] * (len(text) + 1)
        for end, token in self.machine.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - lengths[token]
            if start == 0:
                last[end] = token
            else:
                before = last[start]
                pair = (before, token)
                fits = fitting.get(pair)
                if fits is None:
                    if len(fitting) > 4_000_000:
                        fitting.clear()
                    fits = fitting[pair] = self._fit(before, token)
                if fits:
                    last[end] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= lengths[last[at]]
        out.reverse()
        if len(self.words) >= _MOST_WORDS:
            self.words.clear()
        if len(word) < 64:
            self.words[word] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty."""
        if not text:
            return []
        out: list[int] = []
        word, words = self.word, self.words
        for w in self.cutter.findall(text):
            known = words.get(w)
            out += known if known is not None else word(w)
        return out


_LOADED: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and vocabulary."""
    data = shared.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = Encoder(read_ranks(data))
    return _LOADED[key]


def _share(df: DataFrame, path: str):
    """The vocabulary file, read here and sent to the workers: under a megabyte, whatever the corpus."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16_000_000:
        raise ValueError(f"{path} is too large for a vocabulary")
    return df.sparkSession.sparkContext.broadcast(data)


#: Characters of text per step, which bounds a worker's memory.
_STEP = 4_000_000


def _steps(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        texts = b.column(b.schema.get_field_index(text)).to_pylist()
        a = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= _STEP or i + 1 == len(texts):
                yield b.slice(a, i + 1 - a), texts[a : i + 1]
                a, size = i + 1, 0


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the ids of each text."""
    shared = _share(df, path)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b, texts in _steps(batches, text):
            flat: list[np.ndarray] = []
            sizes = np.zeros(len(texts) + 1, np.int32)
            for i, t in enumerate(texts):
                ids = encoder.encode(t)
                sizes[i + 1] = len(ids)
                flat.append(np.array(ids, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(key)), ids], [key, "ids"])

    return balanced(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def sizes(df: DataFrame, text: str, path: str, to: str = "n_tokens") -> DataFrame:
    """df without its text, with the number of tokens of it (0 for null and empty)."""
    shared = _share(df, path)
    kept = [c for c in df.columns if c not in (text, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b, texts in _steps(batches, text):
            n = pa.array([len(encoder.encode(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), n], [*kept, to])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept), f"`{to}` bigint"])
    return balanced(df.select(*kept, text)).mapInArrow(run, schema)
