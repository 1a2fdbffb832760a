import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreworks.operators import scale


def make(spark, n=300, seed=1):
    r = random.Random(seed)
    data = [
        (i, "hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.choice([None, -2, -1, 1, 2]), r.choice([None, "x", "y"]))
        for i in range(n) if r.random() < 0.8
    ]
    return spark.createDataFrame(data, "seq long, k string, v long, s string").repartition(5)


def test_running_equals_one_long_window(spark, rows):
    df = make(spark)
    got = scale.running(
        df, ["k"], "seq",
        {"a": (F.col("v"), "sum"), "b": (F.col("v"), "min"), "c": (F.col("v"), "max"), "d": (F.col("s"), "last"), "e": (F.col("s"), "prev")},
        segment=7,
    )
    order = Window.partitionBy("k").orderBy("seq")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.sum("v").over(w).alias("a"), F.min("v").over(w).alias("b"), F.max("v").over(w).alias("c"),
        F.last("s", True).over(w).alias("d"), F.lag("s").over(order).alias("e"),
    )
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_running_without_keys(spark):
    df = make(spark).select("seq")
    got = scale.running(df, [], "seq", {"p": (F.col("seq"), "prev")}, segment=5).orderBy("seq").collect()
    assert [r["p"] for r in got] == [None, *[r["seq"] for r in got][:-1]]


def test_dense_number(spark):
    df = make(spark).select("seq")
    got = scale.dense_number(df.withColumnRenamed("seq", "t"), ["t"], "n", 10).orderBy("t").collect()
    assert [r["n"] for r in got] == list(range(11, 11 + len(got)))


def test_contains_join_paths_agree(spark, rows):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("abc%_ ") for _ in range(r.randint(0, 30)))) for i in range(60)]
    needles = [(j, "".join(r.choice("abc%_ ") for _ in range(r.randint(0, 9)))) for j in range(40)]
    want = sorted((i, j) for i, t in texts for j, n in needles if n and n in t)
    t = spark.createDataFrame(texts, "id long, t string")
    n = spark.createDataFrame(needles, "nid long, n string")
    assert rows(scale.contains_join(t, n, "t", "n"), "id", "nid") == want
    assert rows(scale.contains_join(t, n, "t", "n", limit=0), "id", "nid") == want


def test_map_groups_keeps_groups_whole(spark, rows):
    df = make(spark).repartition(7)
    schema = spark.createDataFrame([], "k string, n long, first long").schema
    got = scale.map_groups(df, ["k"], ["seq"], lambda g: [(len(g), g[0][0])], ["seq"], schema)
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_many_needles_are_searched_in_one_pass(spark, rows):
    words = [f"w{i}" for i in range(300)] + ["a", "éa", "w1 w2", ""]
    texts = [(1, "w1 w2 w299"), (2, "éa"), (3, ""), (4, None), (5, "w300"), (6, "w1 w2 w299")]
    t = spark.createDataFrame(texts, "id long, t string")
    n = spark.createDataFrame([(w,) for w in words], "n string")
    want = sorted((i, w) for i, s in texts if s for w in words if w and w in s)
    found = scale.contains_join(t, n, "t", "n")
    assert rows(found, "id", "n") == want
    assert "ArrowEvalPython" in found._jdf.queryExecution().toString()
    assert rows(scale.contains_join(t, n, "t", "n", ship=0), "id", "n") == want
