"""Worked cases of spoken numbers, and whole numbers there and back."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import numbers, text as T

CASES = {
    "two": "2", "thirty one": "31", "five twenty four": "524", "nineteen ninety nine": "1999", "twenty nineteen": "2019", "two point five million": "2500000", "four point two billions": "4200000000s",
    "200 thousand": "200000", "200 thousand dollars": "$200000", "$20 million": "$20000000", "€52.4 million": "€52400000", "£77 thousands": "£77000s", "two double o eight": "2008",
    "three thousand twenty nine": "3029", "forty three thousand two hundred sixty": "43260", "forty three thousand two hundred and sixty": "43260", "nineteen fifties": "1950s", "thirty first": "31st",
    "thirty three thousand and three hundred and thirty third": "33333rd", "three billion": "3000000000", "millions": "1000000s", "july third twenty twenty": "july 3rd 2020",
    "august twenty sixth twenty twenty one": "august 26th 2021", "3 14": "3 14", "3.14": "3.14", "3 point 2": "3.2", "3 point 14": "3.14", "fourteen point 4": "14.4", "two point two five dollars": "$2.25",
    "two hundred million dollars": "$200000000", "$20.1 million": "$20100000", "ninety percent": "90%", "seventy six per cent": "76%", "double oh seven": "007", "double zero seven": "007",
    "nine one one": "911", "nine double one": "911", "one triple oh one": "10001", "two thousandth": "2000th", "thirty two thousandth": "32000th", "minus 500": "-500", "positive twenty thousand": "+20000",
    "two dollars and seventy cents": "$2.70", "3 cents": "¢3", "$0.36": "¢36", "three euros and sixty five cents": "€3.65", "three and a half million": "3500000", "forty eight and a half dollars": "$48.5",
    "b747": "b 747", "10 th": "10th", "10th": "10th", "one of the ones": "one of the ones", "first and second": "1st and 2nd", "per person": "per person", "a point": "a point", "dollars and sense": "dollars and sense",
    "two million and a half": "2000000.5", "well and a half": "well and a half", "oh": "0", "six sixes": "66s", "one hundred and one": "101", "": "", "no number here": "no number here", "twelve hundred": "1200", "eleven o five": "1105",
}


@pytest.mark.parametrize("said,want", CASES.items())
def test_worked_cases(said, want):
    assert numbers.in_digits(said) == want


def test_whole_numbers_there_and_back(spark):
    r = random.Random(1)
    own = [*range(0, 1100), *(r.randrange(10 ** r.randint(3, 15)) for _ in range(2000))]
    rows = spark.createDataFrame([(n,) for n in own], "n long").select("n", numbers.spelled(F.col("n")).alias("said"))
    for g in rows.select("n", "said", numbers.standard_numbers("said").alias("got")).collect():
        assert g["got"] == ("one" if g["n"] == 1 else str(g["n"])), g


def test_normalisation_with_numbers(spark):
    cases = {
        "Well, it's [noise] about TWENTY-one dollars (maybe) and fifty cents!": "well it is about $21.50",
        "Mr. Brown's uh 3rd colour cost £1,000.50.": "mister brown is 3rd color cost £1000.50",
        "the first 10% of two hundred": "the 1st 10% of 200", "": "", "Ünï çödé": "uni code",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    for g in rows.select("t", "want", T.normalise_english(F.col("t"), {"colour": "color"}).alias("got")).collect():
        assert g["got"] == g["want"], g
