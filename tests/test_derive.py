"""Golden cases of text derivation, worked out by hand from the rules."""

import pytest

from annalist.operators.derive import derive_claims, derive_entities, derive_relations
from annalist.plans.catalogue import QUERIES

PHRASES = [
    ("Well so Marble Harbor opened today", ["Marble Harbor", "marble harbor opened today"]),
    ('We read "the quiet orchard" at dawn', ["quiet orchard"]),
    ("okay", []),
    ("bridge", ["bridge"]),
    ("They met. Then Tomas met Ines", ["tomas met ines"]),
    ("", []),
    (None, []),
    ("12 + 30 = 42", []),
]


def entities(spark, texts, hints=None):
    rows = [(i, t, hints) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string, hint_entities array<string>")
    return [r["entities"] for r in derive_entities(df).orderBy("i").collect()]


def test_phrases(spark):
    assert entities(spark, [t for t, _ in PHRASES]) == [p for _, p in PHRASES]


def test_single_words_within_longer_phrases_go(spark):
    assert entities(spark, ["I saw Marble Harbor and Marble"]) == [["Marble Harbor and Marble", "saw marble harbor"]]


def test_never_more_than_eight(spark):
    text = "x " + ", ".join(f"N{c}b{c}x" for c in "abcdefghijkl").replace("N", "Z")
    assert len(entities(spark, [text])[0]) == 8


def test_hints_win_and_generic_heads_add_nothing(spark):
    assert entities(spark, ["Marble Harbor"], ["so blue lantern", None, "project blue lantern", "Blue Lantern", "the"]) == [["blue lantern"]]


@pytest.mark.parametrize(
    ("text", "names", "expected"),
    [
        ("Gate depends on Pump", ["Pump", "Gate"], ("Gate", "Pump", "depends_on")),
        ("Leak caused by Frost", ["Leak", "Frost"], ("Frost", "Leak", "causes")),
        ("Using it, Gate met Pump", ["Gate", "Pump"], ("Gate", "Pump", "uses")),
        ("Gate and Pump rest", ["Gate", "Pump"], None),
        ("Gate uses power", ["Gate"], None),
        ("Gate by Mill uses Pump", ["Gate", "Mill", "Pump"], ("Mill", "Pump", "uses")),
        ("Gate uses Pump", ["Gate", "the", "gate"], None),
    ],
)
def test_relations(spark, text, names, expected):
    df = spark.createDataFrame([(text, names)], "text string, entities array<string>")
    found = [(r["src"], r["dst"], r["type"]) for r in derive_relations(df).collect()]
    assert found == ([expected] if expected else [])


@pytest.mark.parametrize(
    ("text", "confidence", "expected"),
    [
        ("Well, no", 0.9, None),
        ("so The gate is  open..", 0.9, ("The gate", "is", "open")),
        ("The gate is open", 0.8, None),
        ("Is the gate open", 0.9, None),
        ("The gate is open?", 0.9, None),
        ("please note it is open", 0.9, None),
        ("It is wondering about gates", 0.9, None),
        ("There is hope", 0.9, None),
        ("Gates should be shut", 0.9, ("Gates", "should be", "shut")),
        ("Gate is " + "x" * 161, 0.9, None),
        (None, 0.9, None),
        ("Gate is open", None, None),
    ],
)
def test_claims(spark, text, confidence, expected):
    df = spark.createDataFrame([(text, confidence)], "text string, confidence double")
    found = [(r["subject"], r["predicate"], r["object"]) for r in derive_claims(df).collect()]
    assert found == ([expected] if expected else [])


def test_queries_run_over_the_tables(spark):
    for name in ("derive_entities_text", "derive_relations_text"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
