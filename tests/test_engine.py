"""Hand-computed cases of the record engine."""

from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators import similarity as S


def one(spark, column, *values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


def test_normalize(spark):
    assert one(spark, T.normalize, "blt hex s.s. 10mm", "SS304 bolt", "C.S flange,ss;cs:x/y  z", "ASS 5") == [
        "BLT HEX STAINLESS STEEL. 10MM", "SS304 BOLT", "CARBON STEEL FLANGE STAINLESS STEEL CARBON STEEL X Y Z", "ASS 5",
    ]


def test_units_and_prices(spark):
    assert one(spark, T.clean_unit, " A ", "a", "n/a", "", None, "UNKNOWN") == ["A", "A", *["UNSPECIFIED"] * 4]
    raw = ["NOS.", "No's", "EA", "10 KG", "BOXS", "SQ.M", "M.T.", "LOT", "#N/A", "-", None, "WIDGET"]
    want = ["EACH", "EACH", "EACH", "KG", "BOX", "M2", "TONNE", "JOB", *["UNSPECIFIED"] * 3, "WIDGET"]
    assert [u["canonical"] for u in one(spark, T.uom, *raw)] == want
    assert one(spark, T.parse_price, "1,200.50", "Rs 45", "Rs.120", "Rs.1,200.50", "12-3", "-5") == [1200.5, 45.0, 0.12, None, None, -5.0]


def test_communities_of_a_path(spark):
    edges = [(i, j) for i in range(5) for j in range(5) if abs(i - j) <= 1]
    found = S.communities(spark.createDataFrame(edges, "i long, j long"))
    assert {r["member"]: r["seed"] for r in found.collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}


def test_status_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.95, 0.9499, 0.82, 0.8199, 0.75, 0.7499)], "m double")
    assert [r[0] for r in rows.select(T.status(F.col("m"))).collect()] == ["resolved", "accepted", "accepted", "review", "review", "conflict"]
