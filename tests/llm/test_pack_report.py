from veriloom.llm import pack


def test_report_tells_what_packing_came_to(spark):
    rows = [(1, 5, "a", 1), (2, 5, "b", 1), (3, 4, "a", 2), (4, 23, "c", 3), (5, 0, "a", 4), (6, None, None, None), (7, 6, "b", 5)]
    items = spark.createDataFrame(rows, "id int, n int, source string, cluster int")
    r = pack.report(pack.pack(items, "id", "n", 10, "source", "cluster"), items, "id", "n", 10, "source", "cluster").first()
    assert (r["n_items"], r["n_units"], r["n_over"], r["n_cut"], r["n_broken"], r["n_cluster_meetings"]) == (7, 43, 0, 0, 0, 0)
    assert 5 <= r["n_windows"] <= 6 and r["fill"] == round(43 / (10 * r["n_windows"]), 6)
    assert pack.report(pack.pack(items.limit(0), "id", "n", 10, "source", "cluster"), items.limit(0), "id", "n", 10, "source", "cluster").first()["n_items"] == 0
