import random

from pyspark.sql import functions as F

from pointspark.operators import graph


def _leads(edges):
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        lead[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in lead if find(x) != x}


def test_a_hub_is_spread_and_paths_are_joined(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY", 50)
    monkeypatch.setattr(graph, "FOLD_EDGES", 64)
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 1500)] + [(5000 + i, 5001 + i) for i in range(200)] + [(r.randrange(9000, 9400), r.randrange(9000, 9400)) for _ in range(150)] + [(7, 7), (3, 3)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    assert {tuple(x) for x in graph.connected_leads(df).where("node <> lead").collect()} == _leads([e for e in edges if e[0] != e[1]])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged again
    parts = graph._gathered(df.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(p["count"] for p in parts) < 1200  # the hub alone has 1,499


def test_empty(spark):
    assert graph.connected_leads(spark.createDataFrame([], "u long, v long")).count() == 0
