import random

import pytest
from pyspark.sql import functions as F

from veriloom.llm import names
from veriloom.llm.mapping import NONE, Matcher, distance, strip_marks

TERMS = [
    ("e1", "entity", "恒岬银行", []), ("e2", "entity", "恒岬农村商业银行", ["恒岬农商行"]), ("e3", "entity", "恒岬再保险", None), ("e4", "entity", "瑞垄财产保险", ["瑞垄产险"]),
    ("e5", "entity", "Northmere Bank", ["NorthmereB"]), ("e6", "entity", "Northmere Property Insurance", []), ("e7", "entity", "Pellworth Rural Cooperative Bank", ["PellworthRCB"]),
    ("r1", "region", "São Velmo", []), ("r2", "region", "赤屿", []), ("r3", "region", "Port Sável", []), (None, "entity", "x", []), ("z", None, None, None),
]
CASES = [
    ("entity", "恒岬农村业商银行", "e2"), ("entity", "恒岬 農村商業銀行有限公司", "e2"), ("entity", "恒岬农商行", "e2"), ("entity", "(一)恒岬很行总部", "e1"), ("entity", "恒岬再检", "e3"), ("entity", "其中:瑞垄财险", "e4"),
    ("entity", "nORTHMERE bANK PLC", "e5"), ("entity", "Property Insurance Ltd., Northmere", "e6"), ("entity", "Nornhmere Prop. Ins Co., Ltd", "e6"), ("entity", "PellworthRuralCooperativeBnak", "e7"), ("entity", "Pellworth Rural Co-op Bk", "e7"), ("entity", "Nоrthmere​ Bank", "e5"),
    ("entity", "鲸港典当行有限公司", NONE), ("entity", "Zephyr Dock Factoring Ltd", NONE), ("entity", "", NONE), ("entity", " ** ", NONE), ("entity", "unknown filer", NONE),
    ("region", "Velmo, São", "r1"), ("region", "SAO VELMO", "r1"), ("region", "1.赤屿 市小计*", "r2"), ("region", "Thuxby Isle", NONE), ("region", "合并抵消", NONE), ("region", "Sálv, Port", "r3"),
]


@pytest.mark.parametrize("kind,value,want", CASES)
def test_cases(kind, value, want):
    assert Matcher(TERMS).match(kind, value)[0] == want


def test_null_exact_and_unknown_kind():
    m = Matcher(TERMS)
    assert m.match("entity", None)[0] is None and m.match("entity", "恒岬银行") == ("e1", 1.0) and m.match("none", "x")[0] == NONE
    assert Matcher([]).match("entity", "x")[0] == NONE


def test_distance_equals_brute_force():
    def slow(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(2))
        assert distance(a, b) == slow(a, b) and distance(a, b, 1) == min(slow(a, b), 2)


def test_single_typos_lead_back():
    """Held-out check: one random edit in a name of six characters or more still finds its entry."""
    r, m, wrong, n = random.Random(4), Matcher(TERMS), 0, 0
    for tid, kind, name, _ in TERMS[:10]:
        if len(name) < 6:
            continue
        for _ in range(20):
            i = r.randrange(len(name) - 1)
            edits = [name[:i] + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + name[i] + name[i:]]
            n += 1
            wrong += m.match(kind, r.choice(edits))[0] != tid
    assert wrong <= 0.02 * n


def test_marks():
    assert strip_marks("* (a) 2、资产 1)(注1)**") == "资产" and strip_marks("o/w x - note 2") == "x"


def test_rows(spark):
    df = spark.createDataFrame([("1", "恒岬农村业商银行", None), ("2", "恒岬银行", "赤屿市"), ("3", None, "无此地"), ("1", "恒岬农村业商银行", None)], "id string, en string, rn string").withColumns({"kind": F.lit(1), "term_id": F.lit("clash")})
    ref = spark.createDataFrame(TERMS, "term_id string, term_kind string, term_name string, short_names array<string>")
    cells = names.fields(df, "t", "id", ["en", "rn"])
    kinds = {("t", "en"): "entity", ("t", "rn"): "region"}
    got = {(r["record_id"], r["field_name"], r["term_id"]) for r in names.mapped(cells, kinds, ref).collect()}
    assert got == {("1", "en", "e2"), ("2", "rn", "r2"), ("3", "rn", NONE)}
    assert names.mapped(cells.limit(0), kinds, ref).count() == 0
    assert {r["term_id"] for r in names.mapped(cells, kinds, ref.limit(0)).collect()} == {NONE}
