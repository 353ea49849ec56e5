import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.functions import columns as C
from pairloom.operators import blocks as B, patterns as P
from pairloom.operators.blocking import Blocked, Field

P_M, P_U = [[0.6, 0.1, 0.2, 0.1], [0.6, 0.3, 0.1]], [[0.01, 0.04, 0.05, 0.9], [0.1, 0.3, 0.6]]
FIELDS = [Field(C.similarity, C.similarity_level), Field(lambda x, y: F.abs(x - y), lambda gap: C.gap_level(gap, (100.0, 1000.0)))]
NODES = [("row", 3, 1), ("row", 4, 2), ("row", 5, 2), ("row", 6, 0), ("col", 1, 1), ("col", 2, 2), ("col", 3, 2), ("col", 4, 0)]


def made(spark, twice=False, unique=False):
    rng = random.Random(5)
    value = lambda: (rng.choice([None, 1, 1, 2, 3]), rng.choice([None, "", "12", "123", "1234", "99", "129"]), rng.choice([None, 5.0, 90.0, 700.0, 4000.0]))
    a, b = ([(i, *value()) for i in range(n)] for n in (120, 90))
    if unique:
        a, b = [(i, 1, str(i), x) for i, _, _, x in a], [(i, 1, str(i), x) for i, _, _, x in b]
    if twice:
        a, b = [*a, (0, 1, "12", 5.0), (0, 1, "12", 5.0)], [*b, (50, 1, "12", 5.0)]
    return Blocked(spark.createDataFrame(a, "row_id long, block int, x0 string, x1 double"), spark.createDataFrame(b, "col_id long, block int, y0 string, y1 double"), FIELDS)


def plain(files):
    both = files.rows.join(files.cols, "block")
    return P.compare(both, "row_id", "col_id", [C.ordinal_level(F.col("x0"), F.col("y0")), C.distance_level(F.col("x1"), F.col("y1"), (100.0, 1000.0))])


def bag(df):
    return Counter((*r[:2], *(tuple(x) if isinstance(x, list) else x for x in r[2:])) for r in df.collect())


@pytest.mark.parametrize(("twice", "unique"), [(False, False), (True, False), (False, True)])
def test_blocked_is_all_pairs(spark, twice, unique):
    files = made(spark, twice, unique)
    assert files._repeat() != unique
    want = plain(files).cache()
    assert bag(files.pairs()) == bag(want)
    assert bag(files.patterns().select("pattern_id", "n", "gamma")) == bag(P.patterns(want).select("pattern_id", "n", "gamma"))
    for threshold in (-5.0, 0.0, 1.0, 4.5, 9.0):
        assert bag(files.above(P_M, P_U, threshold)) == bag(want.where(P.weight("gamma", P_M, P_U) > threshold))
    links = spark.createDataFrame([(i, j) for i in range(0, 60, 7) for j in range(0, 55, 5)], "row_id long, col_id long")
    assert bag(files.at(links)) == bag(want.join(links, ["row_id", "col_id"]).select("row_id", "col_id", "gamma"))


def test_blocked_inside_and_checks(spark):
    files, nodes = made(spark), spark.createDataFrame(NODES, "side string, id long, label long")
    inside = B.inside_blocks(plain(files), nodes)
    assert bag(files.labelled(nodes).pairs()) == bag(inside)
    assert bag(B.counted_blocks(nodes, files.labelled(nodes).counts("label"))) == bag(B.block_counts(plain(files), nodes))
    assert bag(files.checked()) == bag(plain(files))
    with pytest.raises(ValueError, match="more than once"):
        made(spark, True).checked()


def test_filters_do_not_compare_again(spark):
    """A weight in a filter used to compare the texts anew for every level it names."""
    plan = P.pair_weights(made(spark, unique=True).pairs(), P_M, P_U, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 1
