from pyspark.sql import functions as F

from veriloom.llm import names

KINDS = {("t", "f"): "k"}
LISTED = [("1", "k", "Café cover", ["café cvr"]), ("2", "k", "fast loan", []), ("3", "k", "β-weighted ratio", None), ("4", "k", "资产管理", []), ("5", None, "x", []), ("6", "k", "Βeta рlan", [])]
VALUES = ["Cafe cover", "fsat loan", "β-weighted  ratio", "资产管里", "nothing like it", "fast loan", "Βeta рlan", "Βeta  рlan", "fаst loan", "", None]


def rows(spark):
    cells = spark.createDataFrame([("t", str(i), "f", v) for i, v in enumerate(VALUES)], "table_name string, record_id string, field_name string, value string").filter("value is not null")
    return cells, spark.createDataFrame(LISTED, "term_id string, term_kind string, term_name string, short_names array<string>")


def test_a_list_beyond_the_bound_is_matched_in_blocks(spark):
    cells, listed = rows(spark)
    assert len(list(names.blocks(listed, 2))) > 1 and sum(map(len, names.blocks(listed, 2))) == len(LISTED)
    one, many = ({r["record_id"]: r["term_id"] for r in names.mapped(cells, KINDS, listed, most=m).collect()} for m in (100, 2))
    assert one == many and one["0"] == "1" and one["3"] == "4" and one["4"] == "NONE" and "5" not in one


def test_a_vocabulary_beyond_the_bound_is_joined(spark):
    cells, listed = rows(spark)
    usual = names.usual_words(listed)
    a, b = (sorted((r["value"], r["form"], r["odd"]) for r in names.forms(cells, usual, most=m).collect()) for m in (100, 0))
    assert a == b and len(a) == len(VALUES) - 1
    odd = {v: o for v, _, o in a}
    assert odd["fаst loan"] and not odd["Βeta рlan"] and not odd["β-weighted  ratio"]
    assert names.forms(cells.filter(F.lit(False)), usual, most=0).count() == 0
