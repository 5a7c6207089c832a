"""What a Python worker holds of a forest does not grow with the forest."""

import numpy as np
import pandas as pd

from loggrove.operators import forest as forests
from loggrove.operators.forest import ForestParams

FEATURES = ("a", "b")


def fitted(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(pd.DataFrame({"block_id": [f"b{i}" for i in range(300)], "a": rng.normal(size=300), "b": rng.integers(0, 5, 300).astype(float)}))
    return rows, forests.fit(rows, ForestParams(trees=11, rows_per_tree=20, features=FEATURES))


def test_a_stage_holds_few_passes(spark):
    rows, forest = fitted(spark)
    once, often = forests.score(rows, forest), forests.score(rows, forest, pass_nodes=40)  # a tree a pass
    calls = often._jdf.queryExecution().optimizedPlan().toString().count("run(")
    assert 0 < calls <= forests.PASSES_AT_ONCE and once.columns == often.columns == [*rows.columns, "score"]
    found = {r["block_id"]: r["score"] for r in often.collect()}
    assert len(found) == 300 and all(abs(found[r["block_id"]] - r["score"]) < 1e-12 for r in once.collect())


def test_packed_nodes_are_small_and_missing_values_go_right():
    values = np.random.default_rng(5).normal(size=(64, 2))
    tree = forests.grow_tree(values, 1.0, np.random.default_rng(6))
    flat = forests.pack(pd.DataFrame({**tree, "tree": 0, "node": np.arange(len(tree["rows"]))}))
    assert sum(flat[k].itemsize for k in flat if k != "roots") <= 22
    asked = np.vstack([values, [[np.nan, 0.1], [0.1, np.nan], [np.nan, np.nan]]])
    expected = []
    for row in asked:
        node = 0
        while tree["feature"][node] >= 0:
            node = tree["left"][node] if row[tree["feature"][node]] <= tree["threshold"][node] else tree["right"][node]
        expected.append(tree["path"][node])
    assert (forests.mean_paths(flat, asked, 6) == expected).all()
