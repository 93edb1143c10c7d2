import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.packed import CANDIDATES, DelimiterModel, infer_delimiters, score_delimiters, split_packed

GENRES = DelimiterModel(("|", ",", ";", "/", "\t", "，"))
VALUES = DelimiterModel(("|", ",", ";", "/", "\t", " "))


def split(spark, fields, model, least=1):
    df = spark.createDataFrame(list(enumerate(fields)), "k long, v string")
    out = {}
    for r in split_packed(df, "v", "k", model, least=least).orderBy("rec_id", "pos").collect():
        out.setdefault(r["rec_id"], []).append(r["val"])
        assert r["pos"] == len(out[r["rec_id"]]) - 1
    return [out.get(i, []) for i in range(len(fields))]


def test_notations(spark):
    cases = {
        "Drama|Heist": ["Drama", "Heist"],
        " Drama ;Heist, Space Opera": ["Drama", "Heist", "Space Opera"],
        "|Drama||Heist|": ["Drama", "Heist"],
        '"War, Civil"|Drama': ["War, Civil", "Drama"],
        "'Drama/Stage' / Heist": ["Drama/Stage", "Heist"],
        '"So-Called ""B"" Film",Heist': ['So-Called "B" Film', "Heist"],
        r"'Children\'s'|Heist": ["Children's", "Heist"],
        "'Children''s'": ["Children's"],
        "Children's|Film d'auteur": ["Children's", "Film d'auteur"],
        '["Heist", "Drama"]': ["Heist", "Drama"],
        "Heist，Drama": ["Heist", "Drama"],
        '"open|Drama': ['"open', "Drama"],
        "Drama|Drama": ["Drama", "Drama"],
        "n/a": [], "N/A": [], "-": [], "(none)": [], "": [], "  ": [], '""|Drama': ["Drama"],
        "Sci-Fi": ["Sci-Fi"],
    }
    assert split(spark, [*cases, None], GENRES) == [*cases.values(), []]


def test_blank_as_delimiter(spark):
    assert split(spark, ["12 n3.500  green", '"brushed fit" 7', "x_1\ta-b", "l'eau 4", "'1,225' 3"], VALUES) == [["12", "n3.500", "green"], ["brushed fit", "7"], ["x_1", "a-b"], ["l'eau", "4"], ["1,225", "3"]]


def test_long_fields_and_many_quotes(spark):
    long = "|".join(f"v{i}" for i in range(20_000))
    quoted = '"' + 'a""' * 20_000 + '"|b'
    out = split(spark, [long, quoted], GENRES)
    assert len(out[0]) == 20_000 and out[1] == ["a" + '"a' * 19_999 + '"', "b"]


def test_inference_keeps_blank_apart(spark):
    rng = random.Random(1)
    names = ["Drama", "Space Opera", "Slice of Life", "Heist", "Neo-Noir"]
    fields = [rng.choice("|;,").join(rng.sample(names, rng.randint(1, 3))) for _ in range(400)] + [None, "", "n/a"]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fields)], "v string, k long")
    assert set(infer_delimiters(df, "v").delimiters) == {"|", ";", ","}
    numbers = [rng.choice([" ", "; ", "/"]).join(str(rng.randint(1, 10**6)) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(numbers)], "v string, k long")
    assert set(infer_delimiters(df, "v").delimiters) == {" ", ";", "/"}


def test_empty_null_and_clashing_columns(spark, rows):
    empty = spark.createDataFrame([], "k long, v string")
    assert infer_delimiters(empty, "v").delimiters == () and rows(split_packed(empty, "v", "k")) == []
    assert rows(split_packed(spark.createDataFrame([(1, None)], "k long, v string"), "v", "k")) == []
    clash = spark.createDataFrame([(1, "a|b", 5, "x", "y")], "rec_id long, v string, pos int, val string, vals string")
    assert rows(split_packed(clash, "v", "rec_id", GENRES)) == [(1, 0, "a"), (1, 1, "b")]
    null_key = spark.createDataFrame([(None, "a|b"), (None, "a|b")], "k long, v string")
    assert split_packed(null_key, "v", "k", GENRES).count() == 4


@pytest.mark.parametrize("c", [c for c in CANDIDATES if c not in " \n"])
def test_each_candidate_splits(spark, c):
    assert split(spark, [f"a{c}b{c}{c}c"], DelimiterModel((c,))) == [["a", "b", "c"]]


def test_scores_are_one_row_a_candidate(spark):
    df = spark.createDataFrame([("a|b",), ("a",), ("b",), ("a b",)], "v string")
    got = {r["cand"]: r for r in score_delimiters(df, "v").collect()}
    assert got["|"]["regularity"] == 1.0 and got["|"]["fields"] == 1 and set(got) == {"|", " "}
    assert df.select(F.col("v")).count() == 4
