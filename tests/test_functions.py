"""Parsers and text functions on literal cases."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwell.functions import parse, text


def one(spark, column_of, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column_of(F.col("v"))).collect()]


def test_dates(spark):
    got = one(spark, lambda v: parse.parse_date(parse.tidy(v)), "12/05/2022", "١٢/٠٥/٢٠٢٢", "31/02/2025", "1.2.39", "1-2-50", "1/1/1949", "12/2022", None, "")
    assert got == [dt.date(2022, 5, 12), dt.date(2022, 5, 12), None, dt.date(2039, 2, 1), dt.date(1950, 2, 1), None, None, None, None]


def test_pressure(spark):
    got = one(spark, parse.parse_pressure, "110/71", "70/110", "11/7", "12,5 / 8", "abc", None)
    assert [(r.sys, r.dia, r.format_ok) for r in got] == [(110, 71, True), (70, 110, False), (110, 70, True), (125, 80, True), (None, None, False), (None, None, False)]


def test_numbers(spark):
    assert one(spark, parse.parse_number, "a 3,5 b", "-2.25", "x", None) == [3.5, -2.25, None, None]
    got = one(spark, parse.parse_int, "21 ans", "1G", "2e", "12", "1 2", "3,5", "neuf")
    assert [(r.value, r.format_ok) for r in got] == [(21, True), (1, True), (2, True), (12, True), (1, True), (3, False), (None, False)]


def test_quantities(spark):
    got = one(spark, parse.parse_quantity, "11,8 g/dl", "3.2 kg", "16 SA+3j", "120", "rien", None)
    assert [(r.value, r.unit, r.format_ok) for r in got] == [(11.8, "g/dL", True), (3.2, "kg", True), (16.43, "SA", True), (120.0, "", True), (None, None, False), (None, None, False)]


def test_markers(spark):
    assert one(spark, parse.marker, "—", "x", "X", "NF", "?", "Nsp", " ", None, "12") == ["vide", "vide", None, "vide", "inconnu", "inconnu", "vide", "vide", None]


def test_same_value(spark):
    rows = spark.createDataFrame([(0, "3 kg", "3 g", "quantity"), (1, "—", "nf", "text"), (2, "Fermé", "ferme", "text"), (3, "110/70", "11/7", "bp"), (4, "?", "a", "text")], "i int, a string, b string, k string")
    got = rows.orderBy("i").select(parse.same_value(parse.normalised(F.col("a"), F.col("k")), parse.normalised(F.col("b"), F.col("k"))).alias("s")).collect()
    assert [r.s for r in got] == [True, True, True, True, False]


def test_slug_code_and_script(spark):
    assert one(spark, text.slug, "Œdème  Sévère!", "--", "a" * 39 + " b") == ["oedeme_severe", "x", "a" * 39]
    assert one(spark, text.code_form, "k7-q 2", None) == ["K7Q2", ""]
    assert one(spark, lambda v: text.fold_confused(text.code_form(v)), "K7Q2", "K7O2") == ["K702", "K702"]
    assert one(spark, text.has_unexpected_script, "١١٠/٧٠", "привет", "abc", None) == [True, True, False, False]


def test_personal_data(spark):
    assert one(spark, text.has_personal_data, "AB 123456", "tel 06 12 34 56 78", "12/05/2022", "+212 612345678") == [True, True, False, True]


def test_vocabulary(spark):
    assert one(spark, text.vocabulary_match(), "Ferm", "N ant", "zzz", None) == ["Fermé", "Néant", None, None]


def test_json_answer(spark):
    got = one(spark, text.json_answer, '```json\n{"a": 1}\n```', 'so: {"a": 2} ok', "nothing", None)
    assert got == ['{"a": 1}', '{"a": 2}', "{}", "{}"]
    assert one(spark, text.answer_state, None, " ", "<illisible>", "12") == ["erreur", "vide", "illisible", "ecrit"]


@settings(max_examples=60, deadline=None)
@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_indel_ratio_is_by_longest_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    want = 100.0 if not a and not b else 200.0 * rows[-1][-1] / (len(a) + len(b))
    assert text.indel_ratio(a, b) == pytest.approx(want)


def test_weighted_ratio_order_of_words():
    assert text.weighted_ratio("poids kg", "kg poids") == pytest.approx(95.0)
    assert text.weighted_ratio("", "a") == 0.0
