"""Scalar functions against cases worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quorumlens.functions import hashing, text as T, urls as U
from quorumlens.functions.similar import similarity


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_amounts(spark):
    cases = {
        "€ 27,00": ("27.00", "nl"), "€169.15": ("169.15", "en"), "1.139,50": ("1139.50", "nl"), "1,139.50": ("1139.50", "en"), "139": ("139", "nl"), "139,00": ("139.00", "nl"),
        "1.139": ("1139.00", "nl"), "1,139": ("1139.00", "en"), "12.34.56": (None, None), "Gratis": (None, None), "--": (None, None), "1.1": (None, None), "0,05": ("0.05", "nl"),
        " € 27,00 ": ("27.00", "nl"), "1234.567": (None, None), "": (None, None), "1234,56": ("1234.56", "nl"),
    }
    assert column(spark, cases, T.amount_text) == [v[0] for v in cases.values()]
    assert column(spark, cases, T.notation) == [v[1] for v in cases.values()]
    assert column(spark, ["1.139"], T.amount)[0] == 1139
    assert column(spark, [" Zie  IND ", "139,00"], T.value_key) == ["zie ind", "139.00"]


def test_labels_and_titles(spark):
    assert column(spark, ["Paspoort (volwassene) **", "  A   b", "Straße*", "a - b"], T.label_key) == ["paspoort volwassene", "a b", "strasse", "a  b"]
    names = spark.createDataFrame([("Stap 2: Maak een afspraak in Brazilië!", "Brazilië"), ("STAP 10 - x", ""), ("Oman en Roman", "oman")], "t string, n string")
    assert [r[0] for r in names.select(T.title_key(F.col("t"), F.col("n"))).collect()] == ["maak een afspraak in <land>", "x", "<land> en r<land>"]
    found = spark.createDataFrame([("Paspoort aanvragen als u in Peru woont", "x"), ("Iets", "key")], "t string, v string")
    assert [r[0] for r in found.select(T.country(F.col("t"), F.col("v"))).collect()] == ["Peru", "key"]
    assert column(spark, ["x" * 120, "kort  woord"], T.shorten) == ["x" * 109 + "…", "kort woord"]


def test_sentences_and_fragments(spark):
    got = column(spark, ["Dit is een eerste zin. Kort. Dit is in Peru de tweede zin!\nEen nieuwe regel staat hier"], lambda c: T.sentences(c, F.lit("Peru")))[0]
    assert [s["text"] for s in got] == ["Dit is een eerste zin.", "Dit is in <land> de tweede zin!", "Een nieuwe regel staat hier"]
    text = "Eerste zin. Gebruik   de ID-kaart\nvandaag niet. Slot"
    at = text.index("ID-kaart")
    assert column(spark, [text], lambda c: T.fragment(c, F.lit(at), F.lit(8))) == ["Gebruik de ID-kaart"]
    assert column(spark, ["a <b> ID"], lambda c: T.marked(c, F.lit("id"))) == ["a &lt;b&gt; <mark>ID</mark>"]
    assert column(spark, ["a"], lambda c: T.marked(c, F.lit("zz"))) == ["a"]


def test_answers(spark):
    variants = {"weken": r"(\d+) weken", "nee": "niet mogelijk"}
    assert column(spark, ["Duurt 6 weken.\nNiet mogelijk elders", "niets", None], lambda c: T.answer(c, variants, "anders")) == ["weken 6 + nee", "anders", None]


def test_hashes(spark):
    place = {"land": 'Côte "d\'Ivoire"', "label": "a\\b"}
    row = spark.range(1).select(
        hashing.canonical_location(**{k: F.lit(v) for k, v in place.items()}).alias("j"), hashing.fingerprint(F.lit("r"), **{k: F.lit(v) for k, v in place.items()}).alias("f"),
        hashing.content_hash(F.lit("x")).alias("c")).collect()[0]
    want = json.dumps(place, sort_keys=True, ensure_ascii=False)
    assert row["j"] == want
    assert row["f"] == hashlib.sha1(f"r|~|{want}".encode()).hexdigest()
    assert row["c"] == hashlib.sha256(b"x").hexdigest()[:16]


def test_urls(spark):
    assert column(spark, ["https://a.nl/x/y?q=1", "https://a.nl", "http://a.nl:80/"], U.path_of) == ["/x/y?q=1", "/", "/"]
    assert column(spark, ["https://a.nl:80/x"], U.domain_of) == ["a.nl:80"]
    assert column(spark, ["https://a.nl/x/paspoort-peru/"], lambda c: U.variant_key(c, "paspoort-")) == ["peru"]
    assert column(spark, ["x/y/"], U.clean_path) == ["/x/y"]
    assert column(spark, ["https://a.nl/x//y/z?q", "https://a.nl"], lambda c: U.path_prefix(c, 2)) == ["/x/y", "/"]
    scope = F.array(F.lit("/a/b"))
    assert column(spark, ["/a/b", "/a/b/c", "/a/bc"], lambda c: U.in_scope(c, scope)) == [True, True, False]


@pytest.mark.parametrize(("a", "b", "want"), [("tide", "diet", 0.25), ("diet", "tide", 0.5), ("x", "x", 1.0)])
def test_similarity(spark, a, b, want):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(similarity(F.col("a"), F.col("b"))).collect()[0][0] == pytest.approx(want)


def test_figures_at_the_ends_of_sentences_stay(spark):
    """A sentence that begins or ends with its own number in the list, and blanks at its ends."""
    text = "0 is where it all begins 0\n128 streets are on this map 1\n   Two more are not on it   \n3 of them have no name yet 33"
    got = column(spark, [text], lambda c: T.sentences(c, F.lit("")))[0]
    assert [s["text"] for s in got] == ["0 is where it all begins 0", "128 streets are on this map 1", "Two more are not on it", "3 of them have no name yet 33"]
