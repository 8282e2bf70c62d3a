"""Oversized texts cut into pieces under a size limit, at natural boundaries, with overlap between neighbours.

Recursive bisection: a stretch longer than the limit less the overlap is cut at the strongest boundary near its
midpoint, and both halves are cut again while they are too long; then each piece but the first takes the `overlap`
characters before it. So the cores of the pieces tile the text, and a piece never exceeds the limit.

Sizes are Unicode code points. Boundaries, strongest first: blank line, line end, sentence end, clause end, white
space; where the stretch has none at all the cut is hard, but never before a combining mark, a joiner or a
variation selector. Null and empty texts and texts within the limit are one piece.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Places where a text may be cut, by strength; a cut falls after the match.
_BOUNDARIES = [
    (5, re.compile(r"\n[ \t\r]*\n\s*")),
    (4, re.compile(r"\n\s*")),
    (3, re.compile(r"[。！？!?；;]+[”’」』)\]]*\s*|\.+[”’)\]]*\s+")),
    (2, re.compile(r"[，,、：:]\s*(?![0-9])")),
    (1, re.compile(r"\s+")),
]


def _glued(text: str, at: int) -> bool:
    ch, before = text[at], text[at - 1]
    return bool(unicodedata.combining(ch)) or ch in "‍︎️" or before == "‍" or unicodedata.category(ch) == "Me"


def cut_point(text: str, start: int, end: int) -> int:
    """Where to cut text[start:end]: the strongest boundary in its middle half, the nearest to the midpoint of these; if
    that has none, the nearest boundary anywhere in it."""
    middle, reach = (start + end) // 2, max(1, (end - start) // 4)
    low, high = middle - reach, middle + reach
    for _, pattern in _BOUNDARIES:
        best = None
        for m in pattern.finditer(text, max(start, low - 64), high):
            if low <= m.end() <= high and start < m.end() < end and (best is None or abs(m.end() - middle) < abs(best - middle)):
                best = m.end()
        if best is not None:
            return best
    # Of equally near ones the strongest comes first.
    found = [m.end() for _, pattern in _BOUNDARIES for m in pattern.finditer(text, start, end) if start < m.end() < end]
    if found:
        return min(found, key=lambda x: abs(x - middle))
    at = middle
    while at > low and _glued(text, at):
        at -= 1
    return at if at > low else middle


def pieces(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core_start, end) of each piece in order; the piece is text[start:end]. Null gives one piece of nothing."""
    if not 0 <= overlap < limit or limit - overlap < 2:
        raise ValueError("the overlap must be less than the limit by at least two")
    n = len(text or "")
    if n <= limit:
        return [(0, 0, n)]
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= limit - overlap:
            out.append((max(0, a - overlap), a, b))
        else:
            c = cut_point(text, a, b)
            todo += [(c, b), (a, c)]
    return out


_PIECE = "piece_no int, piece_count int, start int, core_start int, end int, piece_text string"


def split(df: DataFrame, text: str, limit: int, overlap: int) -> DataFrame:
    """df with one row per piece: piece_no (from 0), piece_count, start, core_start, end, piece_text.

    Texts within the limit stay on the JVM. Columns of df with such names are replaced.
    """
    names = [c.split()[0] for c in _PIECE.split(", ")]
    kept = [c for c in df.columns if c not in names]
    df = df.select(*kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cuts = [pieces(t, limit, overlap) for t in b[text]]
            rows = b.loc[b.index.repeat([len(c) for c in cuts])].reset_index(drop=True)
            flat = [(i, len(c), *p, t[p[0] : p[2]]) for t, c in zip(b[text], cuts) for i, p in enumerate(c)]
            yield rows.assign(**{n: [x[k] for x in flat] for k, n in enumerate(names)})

    n = F.coalesce(F.char_length(text), F.lit(0))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), _PIECE])
    small = df.filter(n <= limit).select(*kept, F.lit(0).alias("piece_no"), F.lit(1).alias("piece_count"), F.lit(0).alias("start"), F.lit(0).alias("core_start"), n.alias("end"), F.coalesce(text, F.lit("")).alias("piece_text"))
    return small.unionByName(df.filter(n > limit).mapInPandas(run, schema))


def child_spans(text: str, children: list[tuple[str, str | None]]) -> list[tuple[str, int, int]]:
    """(id, start, end) of each child's text in the parent's, found one after the other.

    A child whose text isn't found takes the gap between its neighbours' spans.
    """
    spans: list[tuple[str, int, int]] = []
    at = 0
    for cid, t in children:
        i = text.find(t, at) if t else -1
        if i < 0:
            spans.append((cid, -1, -1))
        else:
            at = i + len(t)
            spans.append((cid, i, at))
    ends, last = [], 0
    for _, a, b in spans:
        ends.append(last)
        last = b if a >= 0 else last
    out: list[tuple[str, int, int]] = []
    following = len(text)
    for (cid, a, b), before in zip(reversed(spans), reversed(ends)):
        if a < 0:
            out.append((cid, before, following))
        else:
            out.append((cid, a, b))
            following = a
    return out[::-1]


def with_children(parts: DataFrame, parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pieces (parent_chunk_id, start, end, …) with child_chunk_ids: the children that each piece covers, its overlap with
    the piece before included, in the parent's order. parents: (parent_chunk_id, display_text, child_chunk_ids), one row per id; chunks: (chunk_id,
    parent_chunk_id, display_text), repeated rows allowed. A child without a row counts as not found.
    """
    wanted = parents.select("parent_chunk_id", F.posexplode("child_chunk_ids").alias("k", "chunk_id"))
    texts = chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("display_text").alias("child_text"))
    # A parent's list names its children, so the group is as large as one of the parent's own fields.
    grouped = wanted.join(texts, "chunk_id", "left").groupBy("parent_chunk_id").agg(F.array_sort(F.collect_list(F.struct("k", "chunk_id", "child_text"))).alias("children"))
    spanned = parents.select("parent_chunk_id", "display_text").join(grouped, "parent_chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, s) for p, t, kids in zip(b["parent_chunk_id"], b["display_text"], b["children"]) for s in [child_spans(t or "", [(k["chunk_id"], k["child_text"]) for k in kids])]]
            yield pd.DataFrame({"parent_chunk_id": [p for p, _ in rows], "spans": [[{"id": c, "a": a, "b": e} for c, a, e in s] for _, s in rows]})

    spans = spanned.mapInPandas(run, "parent_chunk_id string, spans array<struct<id:string,a:int,b:int>>")
    covered = F.transform(F.filter("spans", lambda s: (s["a"] < F.col("end")) & ((s["b"] > F.col("start")) | ((s["a"] == s["b"]) & (s["a"] >= F.col("start"))))), lambda s: s["id"])
    return parts.join(spans, "parent_chunk_id", "left").withColumn("child_chunk_ids", F.coalesce(covered, F.array().cast("array<string>"))).drop("spans")
