import random

from pyspark.sql import functions as F

from graphloom.operators.hot_keys import eager_join_aggregate, hot_keys

L, R = "c string, n string, v int, left_rows int", "c string, m string, w int, pairs int"


def brute(left, right):
    out = {}
    for c, *_ in left:
        out.setdefault(c, [0, 0, 0, None, None])[0] += 1
    for c, *_ in right:
        out.setdefault(c, [0, 0, 0, None, None])[1] += 1
    for c, n, v, _ in left:
        for d, m, w, _ in right:
            if c is not None and n is not None and (c, n) == (d, m):
                out[c][2] += 1
                for i, x in ((3, v), (4, w)):
                    if x is not None:
                        out[c][i] = (out[c][i] or 0) + x
    return {k: tuple(v) for k, v in out.items()}


def run(spark, left, right):
    a, b = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    df = eager_join_aggregate(a, b, [("c", "c"), ("n", "m")], ["c"], {"v": F.col("v")}, {"w": F.col("w")})
    return {r["c"]: (r["left_rows"], r["right_rows"], r["pairs"], r["v"], r["w"]) for r in df.collect()}


def test_equals_the_join(spark):
    rnd = random.Random(1)
    pick = lambda xs: rnd.choice(xs)
    left = [(pick(["a", "a", "a", "b", None]), pick(["x", "y", None]), pick([1, 2, None]), 0) for _ in range(60)]
    right = [(pick(["a", "a", "c", None]), pick(["x", "y", "z", None]), pick([3, None]), 0) for _ in range(50)]
    assert run(spark, left, right) == brute(left, right)


def test_empty_inputs(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("a", "x", 1, 0)], []) == {"a": (1, 0, 0, None, None)}


def test_hot_key_threshold_is_exact_and_null_key_only_counts(spark):
    left = spark.createDataFrame([("hot",)] * 5 + [(f"k{i}",) for i in range(60)] + [(None,)] * 35, "c string")
    right = spark.createDataFrame([("hot",)] * 4 + [(f"k{i}",) for i in range(96)], "c string")
    rolled = eager_join_aggregate(left, right, [("c", "c")], ["c"])
    assert {tuple(r) for r in hot_keys(rolled, "c", "l", "r").collect()} == {("l", "hot")}
