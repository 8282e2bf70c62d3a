import re
import unicodedata

from pyspark.sql import functions as F

from veriloom import catalog
from veriloom.functions import text

NAMES = [
    "保费收入", "1.保费收入", "１．保费收入", "12、保费 收入＊", "（一）保费收入", "(一)保费收入", "㈠保费收入", "其中：其中:保费收入", "其中：保费\u00a0收入",
    "保费\u3000收入", "保费\u2028收入\x85", "ＲＯＥ（％）", "ﬁxed cafe\u0301", "Ποσοστό", "Доход", "保\u200b费", "*", "", None,
]


def plain(name):
    t = re.sub(r"\s+", "", unicodedata.normalize("NFKC", name)).replace("*", "")
    t = re.sub(r"^\d+[.、]", "", t)
    t = re.sub(r"^\([一二三四五六七八九十]+\)", "", t)
    while t.startswith("其中:"):
        t = t[3:]
    return t


def test_every_name_has_a_key(spark, tmp_path):
    spark.createDataFrame([(n,) for n in NAMES * 2], "metric_name string").write.parquet(f"{tmp_path}/table_facts.parquet")
    rows = catalog.QUERIES["text_label_keys_all"](spark, str(tmp_path)).collect()
    got = {r["metric_name"]: r["label_key"] for r in rows}
    assert got == {n: plain(n) for n in NAMES if n is not None} and len(rows) == len(got)
    assert [got[n] for n in NAMES[:11]] == ["保费收入"] * 11
    assert got["ＲＯＥ（％）"] == "ROE(%)" and got["保\u200b费"] == "保\u200b费"


def test_keys_of_clean_names_stay(spark, data):
    # Where both queries have a name, only the width of its marks may differ.
    names = spark.read.parquet(f"{data}/table_facts.parquet").select("metric_name").filter("metric_name is not null and not metric_name rlike '[^ -~一-鿿、（）：＊]'").distinct()
    old = {r["metric_name"]: r["label_key"] for r in names.withColumn("label_key", text.label_key(F.col("metric_name"))).collect()}
    new = {r["metric_name"]: r["label_key"] for r in catalog.QUERIES["text_label_keys_all"](spark, data).collect()}
    assert old.keys() <= new.keys() and all(unicodedata.normalize("NFKC", k) == new[n] for n, k in old.items())
