"""Fixed-capacity containers filled with items: conflict-constrained best fit.

Open bins are ordered by the room left in them. Each carries a bitmap of the sources and one of the duplicate clusters
of its items. An item, largest first, asks for the tightest bin that holds it; if that bin's bitmaps conflict with the
item, the search goes on to its successor, until the tightest compatible bin is found. Two items conflict if they are
copies of one text, or from one source.

No constraint may cost more room than it must. A source or cluster with more items than there can be bins has to meet
itself somewhere: a group of k items, in a shard that needs at least b bins, may occur ceil(k / b) times per bin; it
has that many bits, and its items take them in turn. And before a new bin is opened for want of a compatible one, the
tightest bin that conflicts by source only is taken (strict=True opens the bin instead). Copies never share a bin
beyond the number above.

Items larger than the capacity are cut: full windows, and a rest that is packed like any item. No other item is cut.
Items of no size (null and empty texts) take no room and get no window. At scale the items are hashed into shards of
about `shard_items`, each packed by itself; a shard leaves at most a few bins partly filled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """shard_items: about how many items are packed together; strict: never two of a source where it can be helped."""

    shard_items: int = 10_000
    strict: bool = False


def _bits(groups: list, b: int) -> list[int]:
    """Per item the bit of its group; a group that must repeat has several, taken in turn. A null group has none."""
    count = Counter(g for g in groups if g is not None)
    first: dict = {}
    at = 0
    for g, k in count.items():
        if k > 1:
            first[g] = (at, -(-k // b))
            at += -(-k // b)
    turn: Counter = Counter()
    out = []
    for g in groups:
        if g not in first:
            out.append(0)
        else:
            start, m = first[g]
            out.append(1 << (start + turn[g] % m))
            turn[g] += 1
    return out


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int, strict: bool = False) -> list[int]:
    """The bin of each item (size, source, cluster); sizes are from 1 to the capacity, largest first."""
    items = list(items)
    least = max(1, -(-sum(s for s, _, _ in items) // capacity))
    sources, clusters = _bits([x[1] for x in items], least), _bits([x[2] for x in items], least)
    by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
    filled = 0  # a bit per room that some bin has
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []

    def tightest(size: int, s: int, c: int) -> tuple[int, int]:
        """(bin, its room): the first bin from `size` on, by room, whose bitmaps don't meet s and c; -1 for none."""
        room, rest = size, filled >> size
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            for b in by_room[room]:
                if not (held_sources[b] & s or held_clusters[b] & c):
                    return b, room
            rest >>= step + 1
            room += 1
        return -1, 0

    for (size, _, _), s, c in zip(items, sources, clusters):
        chosen, room = tightest(size, s, c)
        if chosen < 0 and s and not strict:
            chosen, room = tightest(size, 0, c)
        if chosen < 0:
            chosen, room = len(held_sources), capacity
            held_sources.append(0)
            held_clusters.append(0)
        else:
            del by_room[room][chosen]
            if not by_room[room]:
                filled &= ~(1 << room)
        held_sources[chosen] |= s
        held_clusters[chosen] |= c
        left = room - size
        if left:
            by_room[left][chosen] = None
            filled |= 1 << left
        out.append(chosen)
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, source: str | None = None, cluster: str | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """(key, piece_no, start, n, window_id, position): each item once, an oversized one once per piece.

    start and n are in the unit of size; window_id and position are null for items of no size. A null size counts as
    none. Keys that repeat are items of their own.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    kind = dict(items.dtypes)[key]
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    rows = items.select(
        F.col(key).alias("key"),
        n.alias("size"),
        *((F.when(F.col(c).isNotNull(), F.xxhash64(c)) if c else F.lit(None).cast("long")).alias(n) for c, n in ((source, "source"), (cluster, "cluster"))),
    )
    shards = max(1, round(rows.filter("size > 0").count() / bounds.shard_items))
    whole = rows.filter(F.col("size") >= capacity).select("key", F.posexplode(F.sequence(F.lit(0), (F.col("size") / capacity).cast("int") - 1)).alias("piece_no", "_")).select(
        "key", F.col("piece_no"), (F.col("piece_no").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n"), F.concat(F.lit("full-"), F.col("key").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("window_id"), F.lit(0).alias("position")
    )
    none = rows.filter("size <= 0").select("key", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("window_id"), F.lit(None).cast("int").alias("position"))
    loose = rows.withColumn("full", (F.col("size") / capacity).cast("int")).withColumn("n", F.col("size") - F.col("full").cast("long") * capacity).filter("n > 0")
    loose = loose.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).select("shard", "key", F.col("full").alias("piece_no"), (F.col("full").cast("long") * capacity).alias("start"), "n", "source", "cluster")

    def run(key_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["n", "cluster", "key", "piece_no"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        group = lambda c: [None if pd.isna(x) else x for x in b[c]]
        bins = best_fit(zip(b["n"].tolist(), group("source"), group("cluster")), capacity, bounds.strict)
        b["window_id"] = [f"s{key_[0]}-{x}" for x in bins]
        b["position"] = b.groupby("window_id").cumcount().astype("int32")
        return b[["key", "piece_no", "start", "n", "window_id", "position"]]

    packed = loose.groupBy("shard").applyInPandas(run, f"key {kind}, piece_no int, start bigint, n bigint, window_id string, position int")
    return packed.unionByName(whole).unionByName(none).withColumnRenamed("key", key)


def report(packed: DataFrame, items: DataFrame, key: str, size: str, capacity: int, source: str, cluster: str) -> DataFrame:
    """One row about packed items, of distinct keys: n_items, n_windows, n_units, fill, n_over (windows beyond the
    capacity), n_cut (items in pieces that would have fitted), n_broken (items whose pieces don't add up to their size),
    n_source_meetings and n_cluster_meetings (windows that hold a source, or a cluster, more than once)."""
    x = packed.join(items.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), F.col(source).alias("_source"), F.col(cluster).alias("_cluster")), key)
    whole = x.groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("_size").alias("size"))
    per_item = whole.agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_units"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= capacity)).alias("n_cut"), F.count_if(F.col("n") != F.col("size")).alias("n_broken"))
    meets = lambda c: (F.count(c) > F.count_distinct(c)).cast("int")
    windows = x.filter("window_id is not null").groupBy("window_id").agg(F.sum("n").alias("n"), meets("_source").alias("s"), meets("_cluster").alias("c"))
    per_window = windows.agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("n") > capacity).alias("n_over"), F.sum("s").alias("n_source_meetings"), F.sum("c").alias("n_cluster_meetings"))
    both = per_item.crossJoin(per_window)  # one row each
    return both.select("n_items", "n_windows", "n_units", F.round(F.col("n_units") / (F.col("n_windows") * capacity), 6).alias("fill"), "n_over", "n_cut", "n_broken", "n_source_meetings", "n_cluster_meetings")
