import math

import pytest

from common import crowded, documents, rows
from loggrove.llm import mixing


def level(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while True:
        shares = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / shares >= most * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
        left = sum(sizes.values()) - sum(target.values())
        open_ -= set(over)
    return target | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}


@pytest.fixture(scope="module")
def mixture():
    texts, sources = [], []
    for s, n, words in (("a", 40, 3), ("b", 300, 5), ("c", 200, 9), ("", 60, 4), (None, 30, 2), ("z", 5, 1)):
        for i in range(n):
            texts.append("w " * (words + i % 7))
            sources.append(s)
    return texts, sources


def test_targets_and_taken_words(spark, mixture):
    texts, sources = mixture
    docs = crowded(documents(spark, texts, sources=sources))
    sized = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
    found = mixing.with_copies(sized).collect()
    sizes, taken = {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    wanted = level(sizes, mixing.WEIGHTS)
    for r in found:
        assert math.isclose(r["target"], wanted[r["source"]], rel_tol=1e-12) and r["source_size"] == sizes[r["source"]]
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 2 * 15


def test_reruns_and_partitions_agree(spread, mixture):
    texts, sources = mixture
    docs = documents(spread, texts, sources=sources)
    sized = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
    assert rows(mixing.with_copies(sized), "doc_id", "copies") == rows(mixing.with_copies(sized.repartition(5)), "doc_id", "copies")


def test_mixed_documents_keep_their_columns(spark, mixture):
    texts, sources = mixture
    docs = crowded(documents(spark, texts, sources=sources))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy"]
    sized = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
    assert out.count() == sum(r["copies"] for r in mixing.with_copies(sized).collect())


def test_empty_texts_tables_and_ids(spark):
    docs = documents(spark, [None, "", "a b"], ids=[None, 1, 1], sources=["e", "e", "f"])
    found = mixing.with_copies(docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size")))
    assert rows(found, "doc_id", "source", "size", "source_size", "target", "copies") == sorted(
        [(None, "e", 0, 0, 0.0, 0), (1, "e", 0, 0, 0.0, 0), (1, "f", 2, 2, 2.0, 1)], key=repr)
    assert mixing.mixed(docs.where("false")).count() == 0


def test_repeated_rows_share_their_ranks(spread):
    """Rows of one id, size and source, null ids among them, and a ``copy`` of the input's own."""
    texts = ["a b c"] * 40 + ["x y z"] * 25 + [f"w{i} w" for i in range(60)] + [None, "", " \t"]
    ids = [None] * 40 + [7] * 25 + list(range(100, 160)) + [1, 1, 1]
    sources = ["p"] * 65 + ["q"] * 30 + [None] * 30 + ["p", "q", None]
    docs = documents(spread, texts, ids=ids, sources=sources).selectExpr("*", "'own' AS copy", "1 AS row", "2 AS taken", "3 AS rate")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    sized = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
    copies, found = {}, {}
    for r in mixing.with_copies(sized).collect():
        key = (r["doc_id"], r["source"], r["size"])
        copies[key] = copies.get(key, 0) + r["copies"]
    for r in out.collect():
        key = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        found[key] = found.get(key, 0) + 1
        assert (r["row"], r["taken"], r["rate"]) == (1, 2, 3) and 1 <= r["copy"] <= 3
    assert found == {k: n for k, n in copies.items() if n}


def test_texts_are_not_sorted(spark, mixture):
    texts, sources = mixture
    plan = mixing.mixed(documents(spark, texts, sources=sources))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
