"""Equal rows are walked through the trees once."""

import numpy as np

from loggrove.operators import forest as forests
from loggrove.operators.forest import ForestParams


def test_equal_rows_are_asked_once():
    asked, known = [], {}

    def found(rows):
        asked.extend(map(tuple, rows.tolist()))
        return rows.sum(axis=1)

    values = np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0], [5.0, 6.0]])
    assert forests.remembered(known, 2, values, found).tolist() == [3, 7, 3, 11]
    assert len(asked) == 3 and len(known) == 2
    assert forests.remembered(known, 0, values, found).tolist() == [3, 7, 3, 11]
    assert asked[3:] == [(5.0, 6.0)] and len(known) == 2
    assert forests.remembered(known, 0, values[:0], found).tolist() == []


def test_scores_of_repeated_rows_with_several_models(spark):
    rows = spark.range(600).selectExpr("cast(id as string) as block_id", "cast(id % 5 as double) as a", "cast(id % 3 as double) as b", "if(id % 2 = 0, 'p', 'q') as model")
    settings = {"p": ForestParams(trees=12, rows_per_tree=16, features=("a", "b")), "q": ForestParams(trees=5, rows_per_tree=16, features=("b",), contamination=0.2)}
    forest = forests.train(rows, settings, "model")
    assert forest.cuts["p"] == forests.DEFAULT_CUT
    scored = forests.score(rows, forest, "model").collect()
    for model, names in (("p", ["a", "b"]), ("q", ["b"])):
        own = [r for r in scored if r["model"] == model]
        flat = forests.pack(forest.nodes.where(f"model = '{model}'").toPandas())
        paths = forests.mean_paths(flat, np.array([[r[c] for c in names] for r in own]), 4)
        assert np.allclose([r["score"] for r in own], forests.scores_from_paths(paths, 16), atol=1e-12)
