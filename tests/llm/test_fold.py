import unicodedata

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.llm import names
from veriloom.llm.fold import fold, irregular, words_of

USUAL = ["Tier II capital instruments", "β-weighted exposure ratio", "Café premium", "Вельдория", "Καλδρία", "工程险保费", "小微贷款占比", "Tarn-on-Esk"]
V = words_of(USUAL)

CASES = [
    # value, irregular, form
    ("Ｔｉｅｒ　ＩＩ　ｃａｐｉｔａｌ　ｉｎｓｔｒｕｍｅｎｔｓ", True, "tier ii capital instruments"),
    ("Tier Ⅱ capital instruments", True, "tier ii capital instruments"),
    ("Tіer ΙΙ cаpital instruments", True, "tier ii capital instruments"),
    ("Café premium", True, "café premium"),
    ("Café premium", True, "café premium"),
    ("工程​险保费", True, "工程险保费"),
    ("⼯程险保费", True, "工程险保费"),
    ("エ程险保费", True, "工程险保费"),
    ("Bельдория", True, "вельдория"),
    ("Κɑλδpίɑ", True, "καλδρία"),
    ("Tarn‑on‐Esk", True, "tarn-on-esk"),
    ("Β-WEIGHTED EXPOSURE RATIO", False, "β-weighted exposure ratio"),
    ("Вельдория Prov.", False, "вельдория prov."),
    ("2、工程险保费 ", False, "2、工程险保费"),
    ("銀行", False, "銀行"),
    ("カタカナ", False, "カタカナ"),
    ("teh  tpyo", False, "teh tpyo"),
    ("", False, ""),
    ("   ", False, ""),
    ("​", True, ""),
]


@pytest.mark.parametrize("value,odd,form", CASES)
def test_cases(value, odd, form):
    assert irregular(value, V) is odd and fold(value, V) == form


def test_null_and_usual():
    assert fold(None) is None and not irregular(None)
    assert not any(irregular(n, V) for n in USUAL)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
@example("Cµ")
def test_fold_is_idempotent_and_clean(text):
    once = fold(text, V)
    assert fold(once, V) == once
    assert unicodedata.normalize("NFC", once) == once


def test_on_rows(spark):
    rows = [("1", v, None) for v, _, _ in CASES] + [("2", None, "x" * 100_000 + "​")]
    df = spark.createDataFrame(rows, "id string, a string, b string").withColumn("value", F.lit("clash"))
    cells = names.fields(df, "t", "id", ["a", "b"])
    got = {r["value"]: r for r in names.forms(cells, USUAL).collect()}
    assert all((got[v]["form"], got[v]["odd"]) == (f, o) for v, o, f in CASES)
    assert names.odd_values(cells, USUAL).count() == sum(o for _, o, _ in CASES) + 1
    assert names.forms(cells.limit(0), USUAL).count() == 0
