import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators.graph import connected_components
from pairloom.plans.joins import join_groups


def brute(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1] and None not in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in root and b in root and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    rng = random.Random(4)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1060)] + [(-5, 1000 + 30), (7, 7), (7, None), (3, 4), (3, 4)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(parts)
    assert dict(map(tuple, connected_components(df).collect())) == brute(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_hot_groups_join(spark):
    rows = spark.createDataFrame([(i if i % 3 else 0, f"r{i}") for i in range(9000)], "k long, x string")
    groups = rows.groupBy("k").count().withColumn("y", F.col("k") * 2)
    found = join_groups(rows, groups, ["k"], "count", 9000)
    assert found.columns == ["k", "x", "count", "y"]
    assert sorted((r["x"], r["y"]) for r in found.collect()) == sorted((f"r{i}", 2 * (i if i % 3 else 0)) for i in range(9000))
    assert join_groups(rows.limit(0), groups.limit(0), ["k"], "count", 0).count() == 0
