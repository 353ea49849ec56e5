"""The pipeline's tasks hold one Python worker each, and all of one kind."""

import re

import pytest

import corpus_pipeline
from pairloom.plans.local import local_table

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PYTHON = re.compile(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMap\w*In\w+|\w+InPandas")


def executed(spark):
    """The plans of all queries that ran, as text, by number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {(x := found.apply(k)).executionId(): x.physicalPlanDescription() for k in range(found.size())}


def chained(plan):
    """Pairs of Python operators with no exchange between them, in the tree of a plan."""
    path, out = [], []
    for line in plan.split("\n\n")[0].split("\n"):
        node = re.match(r"([\s:+*|-]*)(?:\* )?(\w.*?)(?: \(\d+\))?$", line)
        if node:
            depth, name = len(node[1]), node[2]
            path = [p for p in path if p[0] < depth]
            if re.search("Exchange|QueryStage", name):
                path = []
            if PYTHON.match(name):
                out += [(p[1], name) for p in path]
                path.append((depth, name))
    return out


def test_one_python_worker_a_task(spark, tmp_path):
    before = executed(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    plans = {k: v for k, v in executed(spark).items() if k not in before}
    assert sum(bool(PYTHON.search(p)) for p in plans.values()) >= 5  # language ID, fingerprints, links, components, packing
    assert [c for p in plans.values() for c in chained(p)] == []
    assert [p for p in plans.values() if "ExistingRDD" in p] == []  # rows of a list, which Python workers convert


def test_chained_operators_are_seen(spark):
    one = spark.range(9).mapInArrow(lambda it: it, "id long")
    before = executed(spark)
    one.mapInArrow(lambda it: it, "id long").collect()
    one.repartition(2).mapInArrow(lambda it: it, "id long").collect()
    both = [chained(p) for k, p in executed(spark).items() if k not in before]
    assert sorted(map(len, both)) == [0, 1]


def test_local_table(spark):
    schema = "a string, b long, c double, d struct<x:double,y:bigint>"
    rows = [("é", 1, 2.0, (0.5, 1 << 62)), (None, None, None, None), ("", -3, 1.5, (None, None))]
    got = local_table(spark, rows, schema)
    assert got.schema == spark.createDataFrame([], schema).schema
    assert [tuple(tuple(x) if isinstance(x, tuple) else x for x in r) for r in got.collect()] == rows
    assert local_table(spark, [], schema).schema == got.schema and local_table(spark, [], schema).count() == 0
