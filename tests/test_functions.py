from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwright.functions import kernels as k
from linkwright.functions import text, translit
from linkwright.functions.phonetic import metaphone

WORDS = st.text(alphabet="abcde ", max_size=12)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, value", [("kitten", "sitting", 800 / 13), ("", "", 100.0), ("abc", "", 0.0), ("abc", "abc", 100.0)])
def test_ratio(a, b, value):
    assert k.ratio(a, b) == pytest.approx(value)


@given(WORDS, WORDS)
def test_kernels_are_symmetric_and_bounded(a, b):
    for kernel in (k.ratio, k.token_sort_ratio, k.token_set_ratio, k.partial_ratio):
        assert kernel(a, b) == pytest.approx(kernel(b, a)) or kernel is k.partial_ratio
        assert 0 <= kernel(a, b) <= 100
    assert 0 <= k.jaro_winkler(a, b) <= 1
    assert k.jaro_winkler(a, a) == 1


@given(WORDS, WORDS)
def test_lcs_against_the_table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert k.lcs_length(a, b) == rows[-1][-1]


def test_named_kernels():
    assert k.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert k.token_set_ratio("acme pvt ltd", "ltd acme") == 100.0
    assert k.token_set_ratio("", "a") == 0.0
    assert k.partial_ratio("abc", "xxabcx") == 100.0
    assert k.best_match("abc", ["abd", "abe"])[0] == "abd"
    assert k.align(["acme", "tradrs"], ["traders", "acme"]) == ([2, 1], 0.0)
    assert k.soft_tfidf([], ["a"], {}) == -1.0
    assert k.soft_tfidf(["a", "b"], ["a", "b"], {}) == pytest.approx(1.0)
    assert k.monge_elkan(["ab"], ["ab", "cd"]) == 1.0


@pytest.mark.parametrize("word, key", [("school", "SKL"), ("phone", "FN"), ("judge", "JJ"), ("church", "XRX"), ("which", "WX"), ("", "")])
def test_metaphone(word, key):
    assert metaphone(word) == key


def test_transliteration():
    assert translit.fold_itrans("garamentsa", "devanagari") == "garments"
    assert translit.to_ascii("गारमेंट्स", {}) == "garments"
    assert translit.to_ascii("भारत Café", {"भारत": "india"}) == "india cafe"


@pytest.mark.parametrize("token, out", [("4gitanjaliplaza", "4 gitanjaliplaza"), ("2ndfloor", "2nd floor"), ("flat502", "flat 502"), ("5th", "5th"), ("plaza", "plaza")])
def test_unglue(spark, token, out):
    assert one(spark, text.unglue(F.lit(token))) == out


@pytest.mark.parametrize("token, out", [("bio1ogics", "biologics"), ("3m", "3m"), ("500", "500")])
def test_deleet(spark, token, out):
    assert one(spark, text.deleet(F.lit(token))) == out


def test_names(spark):
    found = one(spark, text.name_parts(F.lit("x dba y"), F.lit("us")))
    assert (found["core"], found["alias"], found["name_full"]) == ("x", "y", "x dba y")
    for raw, full in (("a.b company", "ab co"), ("www.acme.com", "acme"), ("smith & sons (id: 7)", "smith and sons")):
        assert one(spark, text.name_parts(F.lit(raw), F.lit("us")))["name_full"] == full
    for empty in ("", " "):
        assert one(spark, text.name_parts(F.lit(empty), F.lit("us")))["compact"] == ""


@pytest.mark.parametrize(
    "raw, country, wanted",
    [
        ("Delaware, Ohio", "us", ("", "delaware|ohio", "")),
        ("Flat 004, MH", "india", ("flat", "maharashtra", "4")),
        ("3 bis rue, N°230, Nord", "france", ("b rue", "hauts de france", "3 230")),
        ("3B rue", "france", ("b rue", "", "3")),
        ("<NULL>, n/a", "us", ("", "", "")),
    ],
)
def test_addresses(spark, raw, country, wanted):
    found = one(spark, text.address_parts(F.lit(raw), F.lit(country)))
    assert (found["addr"], found["state"], found["nums"]) == wanted


def test_small_expressions(spark):
    assert one(spark, text.homoglyph_fold(F.lit("lmpoexpo")) == text.homoglyph_fold(F.lit("impoexpo")))
    assert sorted(one(spark, text.char_ngrams(F.lit("Ab-c d"), 3))) == ["abc", "bcd"]
    assert one(spark, text.char_ngrams(F.lit("ab"), 3)) == ["ab"]
    assert one(spark, text.postal_code(F.lit("x 12345-6789"), F.lit("us"))) == "12345"
    assert one(spark, text.script_of(F.lit("a भारत"))) == "devanagari"
    assert one(spark, text.lite(F.lit("Société  d'Œuvre"))) == "societe d oeuvre"
