import random
import re

import pytest

from deskspark import lexicon as lx
from deskspark.operators import rules, termlist

TERMS = [(3, "Late"), (1, "on the way"), (1, "lost"), (7, "$"), (9, "é"), (2, "late"), (4, ""), (5, None), (None, "parcel")]
TEXTS = ["My LATE parcel is on the way", "lately isolated", "paid 5$5 or $7", "café é", "lost/late", "", None, "on  the way"]


def by_hand(text, mode):
    low = (text or "").lower()
    found = set()
    for position, term in TERMS:
        if position is None or not term:
            continue
        plain = re.escape(term.lower())
        if re.search(rf"\b{plain}\b" if mode == "word" else plain, low):
            found.add(position)
    return sorted(found)


@pytest.mark.parametrize("mode", ["word", "substring"])
@pytest.mark.parametrize("block", [termlist.BLOCK_BYTES, 30])
def test_found_terms_by_hand(spark, monkeypatch, mode, block):
    monkeypatch.setattr(termlist, "BLOCK_BYTES", block)
    table = spark.createDataFrame(TERMS, "position int, term string")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    got = {r["id"]: r["found"] for r in termlist.find_terms(df, table, mode=mode).collect()}
    assert got == {i: by_hand(t, mode) for i, t in enumerate(TEXTS)}


def rule_rows(fixed):
    return [(t, i, rule[1]) for i, rule in enumerate(fixed) for t in rule[0]]


@pytest.mark.parametrize("fixed, mode", [(lx.WORD_RULES, "word"), (lx.SUBSTRING_RULES, "substring")])
def test_a_table_of_the_fixed_rules_equals_the_expression(spark, fixed, mode):
    rng = random.Random(5)
    words = [t for rule in fixed for t in rule[0]] + ["the", "x", "$5", "where's", "naïve", "and"]
    joins = [" ", "", "-", ". ", "s "]
    texts = ["".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(6))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string")
    table = spark.createDataFrame(rule_rows(fixed), "term string, position int, intent string")
    want = {r["id"]: r["intent"] for r in rules.classify_rules(df, fixed, mode).collect()}
    got = {r["id"]: r["intent"] for r in termlist.classify_terms(df, table, mode=mode).collect()}
    assert got == want and len(set(got.values())) > 3


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "late"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "term string, position int, intent string")
    assert [r["intent"] for r in termlist.classify_terms(df, none).collect()] == [lx.OTHER] * 2
    table = spark.createDataFrame([("late", 1, "a"), ("late", 1, "b")], "term string, position int, intent string")
    assert termlist.classify_terms(df.where("id > 9"), table).count() == 0
    got = termlist.classify_terms(df, table).orderBy("id").collect()
    assert [(r["first_rule"], r["intent"]) for r in got] == [(1, "a"), (None, lx.OTHER)]


def test_many_terms_equal_a_join(spark):
    rng = random.Random(3)
    letters = "abcde"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(10_000)})
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(60)) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(terms)), "position int, term string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    place = {t: i for i, t in enumerate(terms)}
    got = {r["id"]: r["found"] for r in termlist.find_terms(df, table).collect()}
    assert got == {i: sorted({place[w] for w in t.split() if w in place}) for i, t in enumerate(texts)}
