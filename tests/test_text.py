from pyspark.sql import functions as F

from deskspark.functions import responses as rs
from deskspark.functions import text as tx


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("s"))).collect()]


def test_clean_text(spark):
    given = [None, "", "@a  hi\n\nthere www.x.y", "ok 😀", "a@b.com", "see https://x.y/z?q now", "  x 　y"]
    assert column(spark, given, tx.clean_text) == ["", "", "hi there", "ok 😀", "a.com", "see now", "x y"]


def test_clean_or_raw(spark):
    assert column(spark, [" @only ", "@a b", None], tx.clean_or_raw) == ["@only", "b", ""]


def test_mentions_keep_order_and_duplicates(spark):
    assert column(spark, ["@a b @c_1 @a", None], tx.mentions) == [["a", "c_1", "a"], []]


def test_as_id(spark):
    given = ["12", "12.0", " 7 ", "x", "", None, "9007199254740993"]
    assert column(spark, given, tx.as_id) == [12, 12, 7, None, None, None, 9007199254740993]


def test_entities(spark):
    assert column(spark, ["$1,234.50 and $3 and $4.25x"], tx.money) == [["$1", "$3", "$4.25"]]
    assert column(spark, ["id 111-2223334-5556667 and 1111-2223334-5556667"], tx.order_ids) == [["111-2223334-5556667"]]
    assert column(spark, ["TBA123456789 TBA12345678 xTBA123456789"], tx.tracking_ids) == [["TBA123456789"]]


def test_word_count(spark):
    assert column(spark, [" a  b\nc ", "", None, "one"], tx.word_count) == [3, 0, 0, 1]


def test_normalize_reply(spark):
    given = ['"hello"', "hi ^Help", ' " spaced " ', '"', "x ^Helper"]
    wanted = ["hello ^Help", "hi ^Help", "spaced ^Help", " ^Help", "x ^Helper"]
    assert column(spark, given, tx.normalize_reply) == wanted


def test_parse_ladder(spark):
    good = '{"intent": "cancellation", "confidence": 0.5}'
    raws = [
        good,
        f"```json\n{good}\n```",
        f"I say {good} because",
        "no json",
        f"<think>{{}} hm</think>{good}",
        "<think>only</think>",
        None,
        "{'intent': 'x'}",
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    rows = rs.parse_responses(df, "raw", ["intent", "confidence"]).orderBy("i").collect()
    assert [r["intent"] for r in rows] == ["cancellation"] * 3 + [None, "cancellation", None, None, None]
    assert [r["error"] is None for r in rows] == [True, True, True, False, True, False, False, False]


def test_normalize_label(spark):
    given = ["Billing_Dispute ", "billing", "", None, "zzz", "the refund_return one"]
    wanted = ["billing_dispute", "billing_dispute", "other_unclear", "other_unclear", "other_unclear", "refund_return"]
    assert column(spark, given, rs.normalize_label) == wanted


def test_clamp_confidence(spark):
    assert column(spark, ["1.7", "-1", "0.4", None, "x"], rs.clamp_confidence) == [1.0, 0.0, 0.4, 0.85, 0.85]


def test_ratings_clamp_before_the_mean(spark):
    df = spark.createDataFrame([("9", "0", None), ("3", "x", "2.9")], "groundedness string, tone string, actionability string")
    rows = [tuple(r) for r in rs.normalize_ratings(df).collect()]
    assert rows == [(5, 1, 4, 3.33), (3, 5, 2, 3.33)]


def test_render_prompts(spark):
    df = spark.createDataFrame([("a {b}", None)], "text string, intent string")
    row = rs.render_prompts(df, 'say "{text}" {{json}} [{intent}] {fixed}', {"fixed": "f'x"}).first()
    assert row["prompt"] == "say \"a {b}\" {json} [] f'x"
