from conftest import rows
from spanloom.operators.skew import salted_join


def test_salted_join_equals_the_plain_one(spark):
    large = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1), ("y", 2), (None, 3)], "k string, i int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("x", "c")], "k string, v string")
    for how in ("inner", "left"):
        assert rows(salted_join(large, small, ["k"], "i", how).select("k", "i", "v")) == rows(large.join(small, "k", how).select("k", "i", "v"))
