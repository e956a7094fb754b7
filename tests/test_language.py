from collections import Counter

import pytest
from pyspark.sql import functions as F

from deskspark.lexicon import OTHER
from deskspark.operators import language

DOCS = "/root/testdata/sf0.01/documents.parquet"


def grams_by_hand(text):
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        word = f" {word} "
        found.update(word[i : i + k] for k in (1, 2, 3) for i in range(len(word) - k + 1))
    del found[" "]
    return found


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size]


def code(gram):
    value = 0
    for char in gram:
        value = value << language.BITS | ord(char)
    return value


TEXTS = [
    (1, "en", "The cat sat on the mat, and the dog ran."),
    (2, "en", "This is what they thought of the weather there"),
    (3, "de", "Die Katze saß auf der Matte und der Hund lief."),
    (4, "de", "Das ist, was sie über das Wetter dachten"),
    (5, None, "the thing"),
    (6, None, "und der"),
    (7, "en", ""),
    (8, None, None),
    (9, None, "12 + 7 = 19 !"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, lang string, text string").repartition(3)


def test_profiles_and_distances_by_hand(spark, texts):
    size = 40
    profiles = language.learn_profiles(texts, size=size)
    places = {}
    for lang in ("en", "de"):
        counts = Counter()
        for _, named, text in TEXTS:
            if named == lang:
                counts.update(grams_by_hand(text))
        places[lang] = {g: i for i, g in enumerate(ranked(counts, size), 1)}
    got = {(r["lang"], r["gram"]): r["rank"] for r in profiles.collect()}
    assert got == {(lang, code(g)): i for lang in places for g, i in places[lang].items()}
    for r in language.detect_language(texts, profiles, margin=0, size=size).collect():
        top = ranked(grams_by_hand(r["text"] or ""), size)
        if not top:
            assert (r["lang_guess"], r["lang_guess_distance"], r["lang_guess_runner_up"]) == (None, None, None)
            continue
        gaps = sorted(
            (sum(abs(i - at[g]) if g in at else size for i, g in enumerate(top, 1)), lang) for lang, at in places.items()
        )
        assert (r["lang_guess_distance"], r["lang_guess"], r["lang_guess_runner_up"]) == (*gaps[0], gaps[1][0])


def test_long_texts_count_by_pieces_as_whole(monkeypatch):
    text = " " + " ".join(f"wört{'abc'[i % 3]}er des tages" for i in range(300)) + " "
    whole = [a.tolist() for a in language._grams(text)]
    for piece in (1, 2, 7, 1000):
        monkeypatch.setattr(language, "PIECE", piece)
        assert [a.tolist() for a in language._grams(text)] == whole


def test_held_out_accuracy_and_ambiguous_rows(spark):
    docs = spark.read.parquet(DOCS)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    long = docs.where(F.size(F.split("text", r"\s+")) >= 20)
    right = told = total = 0
    for held in (0, 1):
        profiles = language.learn_profiles(docs.where(fold != held))
        for r in language.detect_language(long.where(fold == held), profiles).collect():
            total += 1
            told += r["lang_guess"] is not None
            right += r["lang_guess"] == r["lang"]
    assert total > 500 and right / total >= 0.95 and right / told >= 0.97


def test_routing_drops_nothing(spark, texts):
    profiles = language.learn_profiles(texts)
    routed = language.route_unlabelled(texts.withColumn("intent", F.lit("a")), profiles, ["en"])
    got = {r["id"]: r["intent"] for r in routed.collect()}
    assert len(got) == len(TEXTS) and got[1] == got[2] == got[5] == "a"
    assert got[3] == got[6] == got[7] == got[8] == got[9] == OTHER


def test_no_profiles_and_no_rows(spark, texts):
    none = language.learn_profiles(texts.where("id > 99"))
    assert none.count() == 0
    assert {r["lang_guess"] for r in language.detect_language(texts, none).collect()} == {None}
    one = language.learn_profiles(texts.where("lang = 'en'"))
    guessed = language.detect_language(texts, one).where("id = 3").first()
    assert (guessed["lang_guess"], guessed["lang_guess_runner_up"]) == ("en", None)
    assert language.detect_language(texts.where("id > 99"), one).count() == 0


def test_too_many_languages_are_refused(spark, texts, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language.detect_language(texts, language.learn_profiles(texts))
