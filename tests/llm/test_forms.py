from veriloom.llm.fold import USUAL_HAN, fold
from veriloom.llm.names import forms


def test_both_paths_give_the_form_of_fold(spark):
    values = ["客戶數", "客戶\u200b數", "靑  A黃", "靑\u00a0a黃", *USUAL_HAN, "plain Name"]
    got = {r["value"]: (r["form"], r["odd"]) for r in forms(spark.createDataFrame([(v,) for v in values], "value string"), []).collect()}
    assert {v: f for v, (f, _) in got.items()} == {v: fold(v) for v in values}
    assert got["客戶數"][0] == got["客戶\u200b數"][0]
    assert not got["客戶數"][1] and got["客戶\u200b數"][1]  # traditional characters are no cases
