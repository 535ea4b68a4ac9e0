import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivener.functions import text
from scrivener.functions.text import error_rate, find_terms, normal, numeral, substring_costs, substring_distance


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("好，那就這樣。 OK？", "好那就這樣OK"), ("ＭＸ－Ｋ", "MXK"), ("mx-k xcf", "MXKXCF"), (None, ""), ("", ""),
        ("二零四", "204"), ("二百零四", "204"), ("六十", "60"), ("十", "10"), ("二十四", "24"), ("一萬", "10000"), ("兩萬", "20000"),
        ("一萬零八", "10008"), ("三十萬五千", "305000"), ("兩邊", "2邊"), ("零件", "0件"),
    ],
)
def test_normal(text, form):
    assert normal(text) == form


def test_fillers_go_only_when_asked():
    assert normal("嗯好呃") == "嗯好呃" and normal("嗯好呃", True) == "好"
    assert numeral("零十") == "10"  # a zero before a unit counts as one


@pytest.mark.parametrize(("ref", "hyp", "rate"), [("", "", 0), ("", "x", 1), ("abcd", "abd", 0.25), ("abc", "", 1), ("abc", "zzabczz", 0)])
def test_error_rate(ref, hyp, rate):
    assert error_rate(ref, hyp) == rate


@pytest.mark.parametrize(("ref", "hyp", "costs"), [("ABCDE", "ABXDE", [0, 0, 1, 0, 0]), ("ABCD", "ABXXCD", [0, 0, 1, 1]), ("ABCD", "AYBCD", [1, 0, 0, 0])])
def test_costs(ref, hyp, costs):
    assert substring_costs(ref, hyp) == (sum(costs), costs)


def plain(ref, hyp):
    row = [0] * (len(hyp) + 1)
    for i, a in enumerate(ref, 1):
        new = [i]
        for j, b in enumerate(hyp, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=30), st.text("abcd", max_size=40))
def test_distance_equals_the_plain_table(ref, hyp):
    distance, costs = substring_costs(ref, hyp)
    assert distance == sum(costs) == substring_distance(ref, hyp) == plain(ref, hyp)
    assert len(costs) == len(ref)


def test_terms_are_taken_longest_first():
    assert find_terms("這批204D要出貨", ["204", "204D"]) == {"204D": 1}
    assert find_terms("MXKND", ["MXK", "KND"]) == {"KND": 1}  # of equal length: by code point
    assert find_terms("AAAA", ["AA"]) == {"AA": 2} and find_terms("", ["A"]) == {} and find_terms("X", ["", "X"]) == {"X": 1}


def test_surplus_at_both_ends_is_free():
    rng = random.Random(1)
    ref = "".join(rng.choice("abcdefgh") for _ in range(50))
    assert substring_distance(ref, "z" * 800 + ref + "z" * 800) == 0


def test_many_pairs_at_once_give_what_each_gives(monkeypatch):
    rng = random.Random(5)
    word = lambda n, letters="ab你c": "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    pairs = [(word(30), word(50)) for _ in range(700)] + [(word(90, "ab"), word(9, "ab")) for _ in range(60)] + [("", "a"), ("a", ""), (None, "a"), ("a", None), ("ab", "ab"), ("ab", "ab"), ("a" * 900, "ba" * 900)]
    refs, hyps = zip(*pairs, strict=True)
    for cells in (text.BATCH_CELLS, 4000):
        monkeypatch.setattr(text, "BATCH_CELLS", cells)
        assert text.substring_distances(refs, hyps) == [text.substring_distance(r or "", h or "") for r, h in pairs]
        assert [x.tolist() for x in text.substring_costs_many(refs, hyps)] == [text.substring_costs(r or "", h or "")[1] for r, h in pairs]


def test_many_short_pairs_take_a_fraction_of_the_calls(monkeypatch):
    calls = []
    own = text._next_rows
    monkeypatch.setattr(text, "_next_rows", lambda *a: calls.append(1) or own(*a))
    monkeypatch.setattr(text, "_next_row", lambda *a: pytest.fail("pairs of like lengths are aligned together"))
    refs = [f"LARGERING{i:05d}" for i in range(2000)]
    text.substring_costs_many(refs, [x[1:] + "X" for x in refs])
    assert len(calls) <= 14 * 40


def test_equal_texts_of_a_batch_are_normalised_once(monkeypatch):
    calls = []
    monkeypatch.setattr(text, "normal", lambda t, drop: calls.append(t) or normal(t, drop))
    out = text.normal_udf.func(pd.Series(["a 一", "a 一", None, "b"]), pd.Series([False] * 4))
    assert out.tolist() == ["A1", "A1", "", "B"] and len(calls) == 3
