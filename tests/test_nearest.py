import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import nearest


@pytest.mark.parametrize("block, group", [(nearest.BLOCK, nearest.GROUP), (64, 3)])
def test_against_sums_one_by_one(spark, block, group):
    rng = np.random.default_rng(1)
    values = [[float(x) for x in rng.integers(-2, 3, 6)] for _ in range(300)]  # many ties
    values[7], values[8], values[9], values[10], values[50] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0], [float("inf")] + [1.0] * 5, [float("nan")] * 6
    rows = spark.createDataFrame(list(enumerate(values)), "vec_id long, v array<double>")
    queries = rows.where("vec_id % 10 = 0 or vec_id = 7").withColumnRenamed("vec_id", "query_id")
    found = {}
    for r in nearest.inner_products(queries, rows, 12, block, group).withColumn("score", F.col("score").cast("string")).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    pairs = queries.select("query_id", F.col("v").alias("q")).crossJoin(rows).where("vec_id <> query_id")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    wanted = {}
    for r in pairs.select("query_id", "vec_id", score.alias("s")).orderBy("query_id", F.desc_nulls_last("s"), "vec_id").withColumn("s", F.col("s").cast("string")).collect():
        wanted.setdefault(r.query_id, []).append((r.vec_id, r.s))
    assert found == {q: rows[:12] for q, rows in wanted.items()}


def test_no_array_expression_makes_the_products(spark, small):
    from gaugeworks import catalog

    plan = catalog.QUERIES["similarity_topk"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan
