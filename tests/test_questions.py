import pytest

from tallyloom.functions import questions as Q


@pytest.mark.parametrize("text, want", [
    ("Questions 1–6", ("range", [1, 2, 3, 4, 5, 6])), ("Question 5", ("set", [5])), ("Questions 1-3, 8 and 10", ("mixed", [1, 2, 3, 8, 10])),
    ("Questions 7 and 8", ("set", [7, 8])), ("Questions 1 to 3 choose", ("range", [1, 2, 3])), ("6-1", None), ("1-4, 4", None), ("none", None), ("3, 2", None),
])
def test_question_numbers(text, want):
    assert Q.question_numbers(text) == want


def test_answer_pairs():
    assert Q.answer_pairs("1 TRUE   14. C") == [(1, "TRUE"), (14, "C")]
    assert Q.answer_pairs("3 12 4 two words") == [(3, "12"), (4, "two words")]
    assert Q.answer_pairs("prose 3 x") == [] and Q.answer_pairs("5 " + "w " * 9) == [] and Q.answer_pairs("") == []


def test_alignment_report():
    m = [(f"a sentence of five words {k}", 0.9, 10 * k) for k in range(10)]
    r = Q.alignment_report([*m, ("x", 0.0, -1)], 100, 90, 0.8)
    assert r["matched_ok"] and r["invented_ok"] and r["length_ok"] and r["order"] == 1.0
    assert not Q.alignment_report([*m[::-1]], 100, 10, 0.8)["order_ok"]


def test_shuffle_and_dependencies():
    assert sorted(Q.shuffled(list(range(9)), "s", 9)) == list(range(9)) and Q.shuffled(list("abc"), "s", 2) == Q.shuffled(list("abc"), "s", 2)
    assert Q.dependency_groups([("r1", "unordered", ["a", "b"]), ("r2", "per_slot", ["c"])]) == {"a": "response r1", "b": "response r1"}
