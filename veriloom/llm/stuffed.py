"""Keyword-stuffed pages, link lists and product tags, told from prose by the mean pointwise mutual information of
neighbouring words and by excessively repeated collocations.

From the whole corpus: how often each word occurs, how often each pair of neighbouring words does, and in how many
documents each pair does. Each pair so has

  pmi      its pointwise mutual information, plain and normalised to at most 1
  excess   the share of its occurrences that repeat it within one document

A place of a text is judged by the means of these over the `window` pairs around it: word salad has a low mean mutual
information for its excess, stuffed phrases a high excess for theirs, prose neither. Where the line runs is a quadratic
form of the three means (RULE). The part of a document's characters at stuffed places is its score; more than half of
them makes it a candidate.

Repeated clauses of a regulation, registers and contents lists can pass that line too. So a check follows, on the
candidates alone: of each term, the share of all its occurrences in the corpus that lie at stuffed places of candidates.
The words of a regulation also occur outside of them, those of spam don't. A candidate is flagged if more than half of
its characters are at places around which the mean share passes a threshold. The check only takes candidates away.

Words are runs of letters (cut at case humps, so that glued tags come apart), single Han or Kana characters, and
numbers, all of which are one word; pairs with a number say nothing here. Terms are words, and for Han neighbouring
pairs of characters.

Null, empty and short texts (fewer than `least` words) are never flagged. All statistics cover all documents. The most
frequent pairs, at most `most`, go to the workers; the others, if there are more, come to the documents by a join. A
pair outside the most frequent ones occurs at most total / most times, so that join has no hot key.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.session import balanced, cut

#: The line between stuffed and other places: weights of 1, m, n, e, mm, mn, me, nn, ne, ee for the means m of pmi, n of
#: normalised pmi and e of excess. A logistic regression (fit_rule) on the documents of sf0.1 with even ids.
RULE = (-0.98135, 6.0815, -102.04, 42.52, -0.96613, 31.914, -21.957, -153.22, 179.2, -17.6)


@dataclass(frozen=True)
class Bounds:
    """rule, bias, span: what makes a place stuffed, over how many pairs; the bias, added to the rule, leans to
    candidates, as the check takes wrong ones away. share, window: from what mean share, over how many places, a place
    is confirmed. half: from what part of its characters on a document counts. least: words below which a text is never
    flagged. most: rows of a statistic that are sent to workers; the rest is joined."""

    rule: tuple[float, ...] = RULE
    bias: float = 1.0
    span: int = 65
    share: float = 0.4
    window: int = 17
    lean: float = 0.4
    half: float = 0.5
    least: int = 12
    most: int = 1_000_000


_OTHER, _LETTER, _SINGLE, _DIGIT = 0, 1, 2, 3
_NUMBER = 0
#: Characters of text per step, which bounds a worker's memory.
_STEP = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _is_single(o: int) -> bool:
    return 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x3040 <= o <= 0x30FF or 0x20000 <= o <= 0x3FFFF


def _kind(o: int) -> int:
    c = chr(o)
    if _is_single(o):
        return _SINGLE
    return _DIGIT if c.isdecimal() else _LETTER if c.isalnum() else _OTHER


class _Letters:
    """Kind, lower case and letter case of every character; filled for a block of 256 when one of it is met."""

    def __init__(self):
        self.kind = np.zeros(0x110000, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.case = np.zeros(0x110000, np.uint8)
        self.known = np.zeros(0x1100, bool)

    def meet(self, points: np.ndarray) -> None:
        blocks = np.unique(points >> 8)
        for b in blocks[~self.known[blocks]]:
            for o in range(int(b) << 8, (int(b) << 8) + 256):
                self.kind[o] = _kind(o)
                self.lower[o] = ord(chr(o).lower()[0])
                self.case[o] = {"Ll": 1, "Lu": 2}.get(unicodedata.category(chr(o)), 0)
            self.known[b] = True


_LETTERS: list[_Letters] = []


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * _P ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


@dataclass
class Spelled:
    """The words of some texts one after the other. codes: Han and Kana the negative of the code point, numbers 0,
    others a positive hash; lengths: characters from each word to the next; doc: number of the text; first, end: the
    range of the words of each word's text."""

    codes: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    end: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, told) of the pair at each word and the next; told is False where the text ends."""
        return _mix(self.codes, np.append(self.codes[1:], 0)), np.append(self.doc[1:], -1) == self.doc

    def worded(self) -> tuple[np.ndarray, np.ndarray]:
        """The same; told is False where a number stands too."""
        p, told = self.pairs()
        return p, told & (self.codes != _NUMBER) & (np.append(self.codes[1:], 0) != _NUMBER)

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, told, counted) of the term at each place: a word, or a Han character with the next (at a run's end:
        the one before, which isn't counted again); numbers are none."""
        c, (p, told) = self.codes, self.pairs()
        han = c < 0
        after = told & han & np.append(han[1:], False)
        before = np.insert(after[:-1], 0, False) & ~after if len(c) else after
        out = np.where(after, p, np.where(before, np.insert(p[:-1], 0, 0) if len(c) else p, c))
        return out, c != _NUMBER, after | (c > 0) | (han & ~before)

    def means(self, values: np.ndarray, told: np.ndarray, low: int, high: int) -> np.ndarray:
        """The mean over the told places from `low` before each place up to, not including, `high` after it."""
        at = np.arange(len(self.codes))
        lo, hi = np.maximum(self.first, at - low), np.minimum(self.end, at + high)
        k = np.concatenate(([0], np.cumsum(told)))
        t = np.concatenate(([0.0], np.cumsum(np.where(told, values, 0.0))))
        return (t[hi] - t[lo]) / np.maximum(1, k[hi] - k[lo])

    def part(self, marked: np.ndarray, n: int) -> np.ndarray:
        """Per text the part of its characters, from the first word on, at marked places."""
        at = np.bincount(self.doc, np.where(marked, self.lengths, 0), n)
        return at / np.maximum(1, np.bincount(self.doc, self.lengths, n))


def spell(texts: list[str | None]) -> Spelled:
    """The words of all texts at once."""
    if not _LETTERS:
        _LETTERS.append(_Letters())
    table = _LETTERS[0]
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) >> 2 for r in raw], np.int64)
    points = np.frombuffer(b"".join(raw), np.uint32)
    begin = np.cumsum(sizes) - sizes
    if not len(points):
        none = np.zeros(0, np.int64)
        return Spelled(none, none, none, none, none)
    table.meet(points)
    kind = table.kind[points]
    case = table.case[points]
    new = np.ones(len(points), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _SINGLE) | ((case[:-1] == 1) & (case[1:] == 2))
    new[begin[sizes > 0]] = True
    at = np.flatnonzero(new & (kind != _OTHER))
    if not len(at):
        none = np.zeros(0, np.int64)
        return Spelled(none, none, none, none, none)
    doc = np.searchsorted(begin, at, "right") - 1
    # Empty texts share their begin with the next one; the last that begins there holds the characters.
    stop = (begin + sizes)[doc]
    lengths = np.minimum(np.append(at[1:], len(points)), stop) - at
    kinds = kind[at]
    codes = np.where(kinds == _SINGLE, -points[at].astype(np.int64), 0)
    if (kinds == _LETTER).any():
        place = np.arange(len(points)) - np.repeat(at, np.diff(np.append(at, len(points)))) if at[0] == 0 else np.concatenate((np.zeros(at[0], np.int64), np.arange(at[0], len(points)) - np.repeat(at, np.diff(np.append(at, len(points))))))
        letters = kind == _LETTER
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(place[letters].max()) + 1, _P))
            told = np.where(letters, (table.lower[points].astype(np.uint64) + np.uint64(1)) * powers[np.where(letters, place, 0)], np.uint64(0))
            h = np.add.reduceat(told, at).view(np.int64)
        word = (_mix(h, h) >> 2) & ((1 << 61) - 1) | (1 << 61)
        codes = np.where(kinds == _LETTER, word, codes)
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    run = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    return Spelled(codes, lengths, doc, edge[run], np.append(edge[1:], len(doc))[run])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches, with the texts of their second column, of about _STEP characters."""
    for b in batches:
        texts = b.column(1).to_pylist()
        a = n = 0
        for i, t in enumerate(texts):
            n += len(t or "")
            if n >= _STEP or i + 1 == len(texts):
                yield b.slice(a, i + 1 - a), texts[a : i + 1]
                a, n = i + 1, 0


def tokenise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of one text."""
    s = spell([text])
    return s.codes, s.lengths


def terms(codes: np.ndarray) -> np.ndarray:
    """The terms of one text's words."""
    none = np.zeros(len(codes), np.int64)
    return Spelled(codes, none, none, none, none + len(codes)).terms()[0]


_WORD, _PAIR = 0, 1


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, code, x, y, c, d) of all words, and pairs (x, y) of neighbouring words, of (key, text): occurrences, and
    for pairs the documents that hold them. Counted per step first, so a hot word costs one row per step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _steps(batches):
            s = spell(texts)
            if not len(s.codes):
                continue
            u, c = np.unique(s.codes, return_counts=True)
            p, told = s.pairs()
            at = np.flatnonzero(told)
            # Places ordered by pair and, as the sort is stable, by text.
            order = at[np.argsort(p[at], kind="stable")]
            q, docs_ = p[order], s.doc[order]
            new = np.ones(len(q), bool)
            new[1:] = q[1:] != q[:-1]
            new_doc = new.copy()
            new_doc[1:] |= docs_[1:] != docs_[:-1]
            head = np.flatnonzero(new)
            first = order[head]
            n_docs = np.add.reduceat(new_doc.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
            kinds = np.repeat(np.array([_WORD, _PAIR], np.int8), (len(u), len(head)))
            both = lambda a, b: pa.array(np.concatenate((a, b)).astype(np.int64))
            none = np.zeros(len(u), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), both(u, q[head]), both(none, s.codes[first]), both(none, s.codes[first + 1] if len(first) else first), both(c, np.diff(np.append(head, len(q)))), both(none, n_docs)],
                ["kind", "code", "x", "y", "c", "d"],
            )

    counted = docs.mapInArrow(run, "kind tinyint, code bigint, x bigint, y bigint, c bigint, d bigint")
    return counted.groupBy("kind", "code").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sum("c").alias("c"), F.sum("d").alias("d"))


class Table:
    """Values by code, for lookups in a worker; 0 for codes that it doesn't hold."""

    def __init__(self, codes: np.ndarray, *values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], [v[order] for v in values]

    def __call__(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(values, known) of codes."""
        if not len(self.codes):
            return [np.zeros(len(codes), np.float32) for _ in self.values], np.zeros(len(codes), bool)
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[i] == codes
        return [np.where(known, v[i], 0) for v in self.values], known


def looked_up(docs: DataFrame, table: DataFrame, weight: str, values: list[str], codes_of: Callable, run: Callable, schema: str, most: int) -> DataFrame:
    """run(batch, spelled, Table, …) over all documents with a table (code, values, weight) at hand.

    The `most` rows of greatest weight go to the workers. What the table holds beyond that is joined to the documents
    that have the codes, and comes to run with them; codes_of(spelled) gives (codes, told).
    """
    spark = docs.sparkSession
    n = table.count()
    head = table.select("code", *values) if n <= most else table.orderBy(F.desc(weight), "code").limit(most).select("code", *values)
    got = head.toArrow()
    # Sorted once here; sorting the sorted again in a worker is cheap.
    order = np.argsort(got.column(0).to_numpy())
    shared = spark.sparkContext.broadcast([got.column(0).to_numpy()[order], *(got.column(i).to_numpy().astype(np.float32)[order] for i in range(1, got.num_columns))])

    if n <= most:

        def whole(batches):
            known = Table(*shared.value)
            for b, texts in _steps(batches):
                yield from run(b, texts, spell(texts), known)

        return docs.mapInArrow(whole, schema)

    key_type = dict(docs.dtypes)["key"]

    def rare(batches):
        known = Table(*shared.value)
        for b, texts in _steps(batches):
            s = spell(texts)
            codes, told = codes_of(s)
            told = told & ~known(codes)[1]
            once = np.unique(np.stack((s.doc[told], codes[told]), 1), axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(once[:, 0])), pa.array(once[:, 1])], ["key", "code"])

    def joined(batches):
        known = Table(*shared.value)
        for b, texts in _steps(batches):
            more = b.column(2)
            # A text with joined values is looked up by itself: its table is its own.
            for i, own in enumerate(more.to_pylist()):
                own = own or []
                t = Table(np.concatenate((known.codes, np.array([o["code"] for o in own], np.int64))), *(np.concatenate((v, np.array([o[c] for o in own], np.float32))) for c, v in zip(values, known.values))) if own else known
                yield from run(b.slice(i, 1), texts[i : i + 1], spell(texts[i : i + 1]), t)

    met = docs.select("key", "text").mapInArrow(rare, f"key {key_type}, code bigint").join(table.select("code", *values), "code")
    met = met.groupBy("key").agg(F.collect_list(F.struct("code", *values)).alias("own"))
    return docs.select("key", "text").join(met, "key", "left").select("key", "text", "own").mapInArrow(joined, schema)


def pair_scores(counts: DataFrame, n_words: float) -> DataFrame:
    """(code, pmi, npmi, excess, c) of every pair of words that are no numbers."""
    words = counts.filter(F.col("kind") == _WORD)
    word = lambda a, n: words.select(F.col("code").alias(a), F.col("c").alias(n))
    x = counts.filter((F.col("kind") == _PAIR) & (F.col("x") != _NUMBER) & (F.col("y") != _NUMBER)).select("code", "x", "y", "c", "d").join(word("x", "cx"), "x").join(word("y", "cy"), "y")
    together = F.log(F.col("c") / n_words)
    pmi = together - F.log(F.col("cx") / n_words) - F.log(F.col("cy") / n_words)
    return x.select("code", pmi.alias("pmi"), (pmi / F.greatest(-together, F.lit(1e-9))).alias("npmi"), (1 - F.col("d") / F.col("c")).alias("excess"), "c")


def window_means(s: Spelled, known: Table, span: int) -> np.ndarray:
    """(places, 3): the means of pmi, normalised pmi and excess over the pairs around each place."""
    p, told = s.worded()
    values, there = known(p)
    told = told & there
    return np.stack([s.means(v, told, span // 2 + 1, span // 2) for v in values], 1)


def squares(means: np.ndarray) -> np.ndarray:
    """1, the means, and their products."""
    m, n, e = means.T
    return np.stack([np.ones(len(m)), m, n, e, m * m, m * n, m * e, n * n, n * e, e * e], 1)


def stuffed_places(s: Spelled, known: Table, bounds: Bounds) -> np.ndarray:
    """Which places are stuffed by mean mutual information and excess."""
    return squares(window_means(s, known, bounds.span)) @ np.array(bounds.rule) + bounds.bias > 0


def fit_rule(means: np.ndarray, stuffed: np.ndarray, rounds: int = 25) -> tuple[float, ...]:
    """The weights of `rule` from window means and labels of places, by logistic regression with a small ridge."""
    x = squares(means)
    mu, sd = x.mean(0), x.std(0) + 1e-9
    mu[0], sd[0] = 0.0, 1.0
    z, b = (x - mu) / sd, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b)), z.T @ (stuffed - p) - 1e-2 * b)
    w = b / sd
    w[0] -= (b / sd * mu).sum()
    return tuple(float(x) for x in w)


def confirmed(s: Spelled, share: np.ndarray, told: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Which places are confirmed: those around which the mean share of the terms passes the threshold."""
    return s.means(share, told, bounds.window // 2, bounds.window // 2 + 1) > bounds.share


def stuffed_part(found: np.ndarray, share: np.ndarray, lengths: np.ndarray, bounds: Bounds) -> float:
    """The confirmed part of one text, of its terms, their shares and lengths."""
    none = np.zeros(len(found), np.int64)
    s = Spelled(found, lengths, none, none, none + len(found))
    return float(s.part(confirmed(s, share, found != _NUMBER, bounds), 1)[0])


def stuffed(docs: DataFrame, key: str, text: str, bounds: Bounds = Bounds()) -> DataFrame:
    """(key, part, checked, flagged) of every document: the part of its characters at stuffed places, for candidates the
    part that the check confirms, and whether both are more than half."""
    b = bounds
    kind = dict(docs.dtypes)[key]
    rows = balanced(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    counts = cut(corpus_counts(rows))
    n_words = float(counts.filter(F.col("kind") == _WORD).agg(F.coalesce(F.sum("c"), F.lit(1))).first()[0])
    pairs = cut(pair_scores(counts, n_words))

    def score(batch, texts, s, known):
        """Every document's part; of candidates the text and the counts of their terms at stuffed places too."""
        n = len(texts)
        marked = stuffed_places(s, known, b) if len(s.codes) else np.zeros(0, bool)
        part = np.where(np.bincount(s.doc, minlength=n) >= b.least, s.part(marked, n), 0.0)
        chosen = part > b.lean
        codes, _, counted = s.terms()
        told = counted & marked & chosen[s.doc]
        spots = [codes[told & (s.doc == i)] if chosen[i] else None for i in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part), pa.array([t if c else None for t, c in zip(texts, chosen)], pa.string()), pa.array(spots, pa.list_(pa.int64()))], ["key", "part", "text", "spots"])

    scored = cut(looked_up(rows, pairs, "c", ["pmi", "npmi", "excess"], Spelled.worded, score, f"key {kind}, part double, text string, spots array<bigint>", b.most))

    # The check.
    inside = scored.select(F.explode("spots").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("inside"))
    held = counts.filter(((F.col("kind") == _WORD) & (F.col("code") != _NUMBER)) | ((F.col("kind") == _PAIR) & (F.col("x") < 0) & (F.col("y") < 0))).select("code", "c")
    shares = cut(inside.join(held, "code").select("code", (F.col("inside") / F.col("c")).alias("share"), F.col("inside").alias("weight")))

    def check(batch, texts, s, known):
        n = len(texts)
        codes, told, _ = s.terms()
        (share,), _ = known(codes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.part(confirmed(s, share, told, b), n))], ["key", "checked"])

    candidates = scored.filter("text is not null").select("key", "text")
    checked = looked_up(candidates, shares, "weight", ["share"], lambda s: s.terms()[:2], check, f"key {kind}, checked double", b.most)
    # Keys may repeat; the copies of a key are told apart by what was found of each, which their text decides.
    checked = checked.groupBy("key").agg(F.max("checked").alias("checked"))
    out = scored.select("key", "part").join(checked, "key", "left")
    flagged = (F.col("part") > b.lean) & (F.col("checked") > b.half)
    return out.select(F.col("key").alias(key), "part", F.when(F.col("part") > b.lean, F.col("checked")).alias("checked"), F.coalesce(flagged, F.lit(False)).alias("flagged"))
