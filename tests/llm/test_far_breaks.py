from veriloom.llm.split import pieces


def test_a_break_outside_the_middle_half_is_taken():
    text = "x" * 399 + " " + "y" * 1500
    assert pieces(text, 1800, 150) == [(0, 0, 400), (250, 400, 1900)]
    assert pieces("x" * 1500 + " " + "y" * 399, 1800, 150)[0] == (0, 0, 1501)
    assert pieces("x" * 1900, 1800, 150)[0] == (0, 0, 950)
