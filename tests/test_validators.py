from pyspark.sql import functions as F

from veilscan.functions.validators import card_ok, luhn_ok, verhoeff_ok


def test_validators(spark):
    df = spark.createDataFrame([("4242 4242 4242 4242",), ("1234 5678 9012 3456",), ("378282246310005",),
                                ("234567890124",), ("234567890121",)], "m STRING")
    r = {x.m: (x.l, x.c, x.v) for x in df.select("m", luhn_ok(F.col("m")).alias("l"), card_ok(F.col("m")).alias("c"),
                                                   verhoeff_ok(F.col("m")).alias("v")).collect()}
    assert r["4242 4242 4242 4242"][:2] == (True, True)
    assert r["1234 5678 9012 3456"][1] is False
    assert r["378282246310005"][1] is True
    assert r["234567890124"][2] is True and r["234567890121"][2] is False
