"""Golden rows for the text functions."""

from pyspark.sql import functions as F

from corpusloom.functions import text as t


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_white_space(spark):
    s = " a b c\x1cd\x85e　f\x0bg​h\n i "
    assert one(spark, s, t.pieces) == s.split()
    assert one(spark, None, t.pieces) is None and one(spark, " \n", t.pieces) == []


def test_mixed_pieces(spark):
    cut = lambda c: t.marked(t.runs(c))
    assert one(spark, "1975కి", cut) == ["1975@@", "కి"]
    assert one(spark, "GSMను", cut) == ["GSM@@", "ను"]
    assert one(spark, "GSMను1975కి", cut) == ["GSM@@", "ను@@", "1975@@", "కి"]
    assert one(spark, "a@@కి", cut) == ["a@@", "కి"] and one(spark, "a@@కి", lambda c: t.marked(t.runs(c), always=True)) == ["a@@@@", "కి"]


def test_classes_and_marks(spark):
    assert [one(spark, x, t.token_class) for x in ("కి", "1975కి", "1975")] == ["pure", "mixed", "other"]
    assert [one(spark, x, t.base_form) for x in ("ab@@", "@@", "ab")] == ["ab", "", "ab"]


def test_joined(spark):
    text = lambda c: t.joined(F.split(c, " "))
    assert one(spark, "రైతు@@ ల@@ ను met by the river", text) == "రైతులను met by the river"
    assert one(spark, "x@@ y@@", text) == "xy@@"
    assert one(spark, "x@@ y@@", lambda c: t.joined(F.split(c, " "), strip_rest=True)) == "xy"


def test_dampening(spark):
    rows = spark.createDataFrame([(1,), (2,), (7,)], "n bigint")
    assert [r[0] for r in rows.select(t.dampened(F.col("n"), "log")).collect()] == [1, 2, 3]
    assert [r[0] for r in rows.select(t.dampened(F.col("n"), "ones")).collect()] == [1, 1, 1]
