"""Normal forms and tests of text, one row per case."""

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import lexicons as L
from vellumflow.functions import text as T


def check(spark, cases, column):
    """cases: (input, expected)."""
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]
    assert got == [c[1] for c in cases]


@pytest.mark.parametrize(
    ("column", "cases"),
    [
        (T.snake, [("Chest Pain", "chest_pain"), ("chest-pain/x", "chest_pain_x"), (" _A!b_ ", "ab"), (None, "")]),
        (T.dose, [("10 MG", "10_mg"), ("5milligrams", "5_mg"), ("2.5", "2.5"), ("as told", "as_told"), (None, "")]),
        (T.frequency, [("q12h", "every_12_hours"), ("bid", "twice_daily"), ("daily", "once_daily"), ("as_needed", "as_needed"), ("once_a_day", "once_daily"), ("whenever", "whenever")]),
        (T.duration, [("2 weeks", "2_week"), ("since yesterday", "1_day"), ("long", "long")]),
        (T.assertion, [("Denied", "absent"), ("maybe", "possible"), ("x", "present"), (None, "present")]),
        (T.allergen, [("PCN", "penicillin"), ("Peanut butter", "peanuts"), ("tree nuts", "tree_nuts"), ("penicillin vk", "penicillin"), ("kiwi", "kiwi"), ("", "")]),
        (T.drug_name, [("Albuterol inhaler", "albuterol"), ("polyethylene_glycol", "polyethyleneglycol"), ("Generic Lipitor tablets", "lipitor")]),
        (T.is_filler, [("Hi.", True), ("Hello, I have chest pain since Monday", False), ("Thanks", True)]),
        (T.is_backchannel, [("okay", True), ("Yes.", True), ("no", False), ("It hurts", False)]),
        (T.drop_superscripts, [("word¹ x² y⁴", "word x² y")]),
        (T.drop_bracket_citations, [("a [1], b [2-5, 7] c [x]", "a , b  c [x]"), ("end^1,2 z", "end z")]),
        (T.drop_author_citations, [("so (Smith 2023) it (Doe et al., 2019; Roe 2020) is (not this)", "so  it  is (not this)")]),
        (T.tidy_space, [("exam-\nple  a\t b\n\n\n\nc ", "example a b\n\nc")]),
        (T.is_page_number, [("Page 12", True), ("12 / 30", True), ("12 a", False)]),
        (T.is_reference, [("1. Smith J, Doe A. T. J Med. 2020;45(3):123-130.", True), ("1. First of all", False)]),
        (T.skips_heading, [("Part > Indexed terms", True), ("Part > Dosage", False), (None, False)]),
        (T.n_words, [("a b  c", 3), ("  ", 0)]),
    ],
    ids=lambda x: getattr(x, "__name__", "cases"),
)
def test_column(spark, column, cases):
    check(spark, cases, column)


def test_vital_and_demographic(spark):
    df = spark.createDataFrame([("bp", "120 / 80 mmHg"), ("temp", "98.6°F"), ("hr", "72 bpm")], "k string, v string")
    assert [r[0] for r in df.select(T.vital_value(F.col("k"), F.col("v"))).collect()] == ["120/80", "98.6", "72"]
    df = spark.createDataFrame([("age", "45 years"), ("sex", "F"), ("race_ethnicity", "Black"), ("sex", "unknown"), ("sexual_orientation", "Bi")], "k string, v string")
    assert [r[0] for r in df.select(T.demographic(F.col("k"), F.col("v"))).collect()] == ["45", "female", "african_american", "", "bisexual"]


def test_doctor_score_counts_parts_of_words(spark):
    df = spark.createDataFrame([("The doctor said three, sorry",), ("Take 10 mg daily",), ("fine",)], "x string")
    got = [r[0] for r in df.select(T.doctor_score(F.col("x"))).collect()]
    assert got[0] >= 6 and got[1] >= 7 and got[2] == 0


def test_assertion_window(spark):
    df = spark.createDataFrame([("no fever", "fever"), ("maybe likely fever", "fever"), ("fever", "fever"), ("runny nose", "runny nose"), ("x" * 40 + " fever no", "cough")], "t string, s string")
    assert [r[0] for r in df.select(T.assertion_of(F.col("t"), F.col("s"))).collect()] == ["absent", "possible", "present", "absent", "absent"]


def test_front_matter(spark):
    df = spark.createDataFrame([("Short Title", 0), ("THE WHOLE GUIDELINE ON THIS", 9), ("By someone, MD", 9), ("This is a plain sentence of text.", 9), ("Short Title", 20)], "x string, i int")
    assert [r[0] for r in df.select(T.is_front_matter(F.col("x"), F.col("i"))).collect()] == [True, True, True, False, False]


def test_table_sizes():
    assert (len(L.SYMPTOMS), len(L.DRUGS), len(L.DRUG_ALIASES), len(L.BOILERPLATE)) == (69, 191, 13, 35)
