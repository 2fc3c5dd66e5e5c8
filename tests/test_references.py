import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import references as R

T0 = dt.datetime(2025, 1, 1)
REFS, VERSIONS = "src string, row_id string, c string, ref string, at timestamp_ntz", "c string, id string, at timestamp_ntz, until timestamp_ntz"


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def brute(refs, versions):
    out = []
    for src, row, c, ref, t in refs:
        if ref is None or not ref.strip():
            continue
        own = [(a, u) for vc, i, a, u in versions if (vc, i) == (c, ref)]
        cause = None
        if not own:
            cause = "missing"
        elif t is not None:
            begun = [(a, u) for a, u in own if a is not None and a <= t]
            if not begun:
                cause = "late"
            elif not any(u is None or u > t for _, u in begun):
                cause = "deleted"
        if cause:
            out.append((src, row, c, ref, t, cause))
    return sorted(out, key=repr)


def run(spark, refs, versions, **options):
    r, v = spark.createDataFrame(refs, REFS), spark.createDataFrame(versions, VERSIONS)
    r = r.filter(R.is_reference(F.col("ref"))).select("src", "row_id", R.reference_key("k", F.col("c"), F.col("ref")).alias("key"), "at")
    v = v.filter("id IS NOT NULL").select(R.reference_key("k", F.col("c"), F.col("id")).alias("key"), "at", "until")
    got = R.find_orphans(r, v, **options).select("src", "row_id", "corpus_id", "ref_id", "at", "cause").collect()
    return sorted(map(tuple, got), key=repr)


def cases(seed):
    rnd = random.Random(seed)
    ids = ["a", "b", "c:1", "1:c", "Ａ", "a ", "long" * 2000]
    refs = [("s", f"r{i}", rnd.choice(["x", "1", None]), rnd.choice([*ids, "gone", None, "", " 　"]), day(rnd.choice([None, 1, 2, 3, 4, 5]))) for i in range(300)]
    refs += [("s", f"h{i}", "x", "a", day(i % 6)) for i in range(400)]  # one hot reference
    refs += refs[:20]
    versions = [(rnd.choice(["x", "1", None]), rnd.choice(ids), day(rnd.choice([None, 0, 1, 2, 3, 4, 5])), day(rnd.choice([None, None, 2, 3, 4, 6]))) for _ in range(40)]
    return refs, [*versions, *versions[:5], ("x", None, day(0), None)]


def test_equals_brute_force(spark):
    for seed in range(3):
        refs, versions = cases(seed)
        assert run(spark, refs, versions, ranges=5) == brute(refs, versions)


def test_split_of_a_hot_key_changes_nothing(spark):
    refs, versions = cases(9)
    hot = R.reference_key("k", F.lit("x"), F.lit("a"))
    key = spark.range(1).select(hot.alias("k")).first()["k"]
    assert run(spark, refs, versions, ranges=6, hot=[key]) == brute(refs, versions)


def test_empty_sides(spark):
    refs = [("s", "r", "x", "a", day(1))]
    assert run(spark, [], [("x", "a", day(0), None)]) == []
    assert run(spark, refs, []) == brute(refs, [])


def test_key_round_trip(spark):
    pairs = [("a", "b"), (None, "b"), ("", ":x"), ("3:z", "q"), ("é", "ü"), ("1", "2:3:")]
    df = spark.createDataFrame(pairs, "c string, r string").withColumn("key", R.reference_key("k", F.col("c"), F.col("r")))
    c, r = R.split_key(F.col("key"))
    assert [tuple(x) for x in df.select(c, r).collect()] == pairs
    assert df.select("key").distinct().count() == len(pairs)


def test_probe_on_arrays():
    keys = np.array(["b", "a", "a"], object)
    p = R.SortedParents(keys, np.array([5, 1, 3]), np.array([9, 2, 4]))
    causes = p.probe(np.array(["a", "a", "b", "b", "c"], object), np.array([1, 2, 4, 5, 5]), np.ones(5, bool))
    assert causes.tolist() == [0, 2, 3, 0, 1]
