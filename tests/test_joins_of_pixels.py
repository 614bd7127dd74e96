"""Pixels are never sent to the driver, however small Spark takes the rows they are drawn from."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["snapped_lines", "edge_snap", "mosaics", "shifted_frames"])
def test_no_exploded_rows_are_broadcast(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = plan[i + 1 :]
            end = next((j for j, other in enumerate(below) if depth(other) <= depth(line)), len(below))
            assert not any("Generate" in other for other in below[:end]), line
