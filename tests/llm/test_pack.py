import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veriloom.llm.pack import Bounds, best_fit, pack


def items(n, seed=1):
    r = random.Random(seed)
    return sorted(((r.randrange(1, 101), r.randrange(12), r.randrange(300) if r.random() < 0.3 else None) for _ in range(n)), key=lambda x: -x[0])


def test_without_conflicts_it_is_best_fit():
    def slow(sizes, cap):
        rooms, out = [], []
        for s in sizes:
            fit = [(x, i) for i, x in enumerate(rooms) if x >= s]
            i = min(fit)[1] if fit else len(rooms)
            if not fit:
                rooms.append(cap)
            rooms[i] -= s
            out.append(rooms[i])
        return len(rooms), sorted(rooms)

    it = [(s, None, None) for s, _, _ in items(400)]
    bins = best_fit(it, 100)
    room = defaultdict(lambda: 100)
    for (s, _, _), b in zip(it, bins):
        room[b] -= s
    assert (len(room), sorted(room.values())) == slow([s for s, _, _ in it], 100)


def test_copies_part_and_room_is_used():
    it = items(2000)
    for strict in (False, True):
        bins = best_fit(it, 100, strict)
        held = defaultdict(list)
        for x, b in zip(it, bins):
            held[b].append(x)
        assert all(sum(s for s, _, _ in v) <= 100 for v in held.values())
        assert all(len({c for _, _, c in v if c is not None}) == sum(c is not None for _, _, c in v) for v in held.values())
    assert sum(s for s, _, _ in it) / len(set(best_fit(it, 100))) > 97


def test_a_group_with_a_third_of_all_rows_must_meet_itself():
    it = [(10, "s", "same")] * 300 + [(10, None, None)] * 600
    bins = best_fit(it, 100)
    assert len(set(bins)) == 90
    count = defaultdict(int)
    for b in bins[:300]:
        count[b] += 1
    assert max(count.values()) <= 4


def test_rows(spark):
    rows = [(i, s, f"s{c}", None if k is None else str(k)) for i, (s, c, k) in enumerate(items(500))] + [(1000, 250, "s", "c"), (1001, 0, None, None), (1002, None, None, None), (1003, 200, "s", None)]
    df = spark.createDataFrame(rows, "id long, n long, source string, copies string").withColumns({"key": F.lit(0), "size": F.lit("clash")})
    out = pack(df, "id", "n", 100, "source", "copies", Bounds(shard_items=150)).collect()
    total, room = defaultdict(int), defaultdict(int)
    for r in out:
        total[r["id"]] += r["n"]
        if r["window_id"]:
            room[r["window_id"]] += r["n"]
    assert total == {i: n or 0 for i, n, _, _ in rows} and max(room.values()) <= 100
    assert [(r["piece_no"], r["start"], r["n"]) for r in sorted(out, key=lambda r: r["piece_no"]) if r["id"] == 1000] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(r["window_id"] is None for r in out if r["id"] in (1001, 1002)) and len(out) == 500 + 3 + 2 + 2
    assert pack(df.limit(0), "id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)
