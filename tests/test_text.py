import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions import lookup, text


def test_folds_like_python(spark):
    random.seed(1)
    words = ["Straße ſ", "ΣΑΣ ﬁn", " a　b\x1c c ", "İx", "", "ＡＣ/ＤＣ",
        *["".join(chr(random.choice([random.randrange(32, 0x2FF), random.randrange(0x370, 0x590),
            random.randrange(0xAC00, 0xAD00)])) for _ in range(12)) for _ in range(200)]]
    words = [w for w in words if not any(unicodedata.category(c) == "Cs" for c in w)]
    df = spark.createDataFrame([(w,) for w in words], "a string").select("a", text.norm_alias(F.col("a")).alias("n"),
        text.norm_name("a").alias("m"))
    for r in df.collect():
        assert " ".join(r.n.split()) == " ".join(r.a.casefold().split()), r.a
        assert r.m == text.folded(r.a)


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_folded_is_stable(s):
    once = text.folded(s)
    assert text.folded(once) == once or any(unicodedata.normalize("NFKC", c.casefold()) != c.casefold() for c in s)


def test_small_functions(spark):
    df = spark.createDataFrame([("a/b: c", "0.7"), ("", "x"), (None, None)], "a string, c string")
    got = df.select(text.safe_filename(F.col("a")).alias("f"), text.confidence(F.col("c")).alias("c"),
        text.valid_confidence(F.col("c")).alias("v"), text.yaml_scalar(F.col("a")).alias("y")).collect()
    assert [tuple(r) for r in got] == [("a_b_ c", 0.7, True, '"a/b: c"'), ("untitled", 1.0, False, '""'), ("untitled", 1.0, False, '""')]
    n = spark.createDataFrame([(float("nan"),), (2.0,), (-1.0,)], "c double")
    assert [r[0] for r in n.select(text.confidence(F.col("c"))).collect()] == [1.0, 1.0, 0.0]
    assert [r[0] for r in n.select(text.confidence(F.col("c"), 0.5, finite_only=True)).collect()] == [0.5, 1.0, 0.0]


def test_lookups(spark):
    df = spark.createDataFrame([("Company ", "Owned-By"), ("x", "likes"), (None, None)], "t string, r string")
    assert [tuple(r) for r in df.select(lookup.entity_type(F.col("t")), lookup.relation_type(F.col("r"))).collect()] == [
        ("Organizations", "owned_by"), ("Concepts", "likes"), ("Concepts", "")]
    p = spark.createDataFrame([("A", "b"), (None, "zz"), ("b", "B")], "a string, b string")
    assert [r[0] for r in p.select(lookup.compare_priority(F.col("a"), F.col("b"), {"a": 100, "b": 90})).collect()] == [1, -1, 0]


def test_wikilink_parts(spark):
    df = spark.createDataFrame([("T#H|D",), ("T",), ("T|D",)], "a string").select(text.parse_wikilink(F.col("a")).alias("x")).select("x.*")
    got = df.select("*", text.format_wikilink(F.col("target"), F.col("heading"), F.col("display")).alias("back")).collect()
    assert [tuple(r) for r in got] == [("T", "H", "D", "[[T#H|D]]"), ("T", None, None, "[[T]]"), ("T", None, "D", "[[T|D]]")]
