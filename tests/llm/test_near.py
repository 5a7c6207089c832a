import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import crowded, documents, near_components, rows, shingle_set
from loggrove.llm import near


def corpus():
    random.seed(5)
    words = [f"W{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = random.choices(words, k=random.randint(8, 120))
        texts.append(" ".join(base))
        for _ in range(random.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 15))):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy).lower() if random.random() < 0.5 else "\t".join(copy))
    # A large group of near copies of one text, and texts that share a passage and nothing else.
    base = random.choices(words, k=60)
    for i in range(60):
        copy = list(base)
        copy[random.randrange(60)] = f"x{i}"
        if i % 3 == 0:
            copy[random.randrange(60)] = f"y{i}"
        texts.append(" ".join(copy))
    passage = random.choices(words, k=30)
    texts += [" ".join(random.choices(words, k=20) + passage) for _ in range(20)]
    return texts + ["one", "one", "ONE ", "two words", "Two  words", "", None, " \n", "É é", "é é"]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, size):
    texts = corpus()
    found = near.near_components(crowded(documents(spark, texts)), size=size, limit=16)
    wanted = near_components(list(enumerate(texts, 1)), size)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(((i, n, c, c == i) for i, (n, c) in wanted.items()), key=repr)


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    docs = documents(spark, [a, a, b, b, a, None], ids=[4, 4, 4, None, 9, None])
    found = rows(near.near_components(docs, size=2), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted([(4, 6, 4, True), (4, 6, 4, True), (4, 6, 4, True), (None, 6, 4, False), (9, 6, 4, False), (None, 0, None, True)], key=repr)


def test_empty_tables(spark):
    assert near.near_components(documents(spark, ["a"]).where("false")).count() == 0
    assert near.near_components(documents(spark, [None, ""])).count() == 2


def test_kept_documents_have_all_columns(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "x y z u v w q r"]
    docs = crowded(documents(spark, texts))
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(1,), (3,)]


def test_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    docs = documents(spark, [long, long + " end", "short text of a few words"])
    assert rows(near.near_components(docs, size=2), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_a_pair_in_a_crowd_with_a_common_passage(spark):
    """Thousands of sets share 85% of their shingles, and some pairs of them are at 0.8."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(851)]
    own = lambda n: [f"o{rng.getrandbits(60)}" for _ in range(n)]
    texts, pairs = [], 20
    for _ in range(1500):
        texts.append(" ".join(passage + own(150)))
    for _ in range(pairs):
        shared = own(42)
        texts += [" ".join(passage + shared + own(106)), " ".join(passage + shared + own(106))]
    found = {r["doc_id"]: r["component_id"] for r in near.near_components(documents(spark, texts), size=2).collect()}
    first = 1501
    assert all(found[first + 2 * i] == found[first + 2 * i + 1] == first + 2 * i for i in range(pairs))
    assert all(found[i] == i for i in range(1, first))


@pytest.mark.parametrize("group", [8, 1024])
def test_crowds_are_joined_exactly(spark, group):
    """All pairs between components that are at 0.8 are met, also where a shingle's members are dealt into blocks."""
    texts = [t for t in corpus() if t]
    size = 2
    made = near.signatures(documents(spark, texts), size).where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = made.withColumn("node", F.col("doc_id")).withColumn("comp", F.col("doc_id"))
    sets = near._member_sets(nodes.select("node"), nodes, documents(spark, texts), size)
    met = {tuple(r) for r in near._met_in_crowds(nodes.join(sets.select("node", "members"), "node"), group).collect()}
    plain = {r["node"]: shingle_set(texts[r["node"] - 1], size) for r in nodes.select("node").collect()}
    wanted = {(a, b) for a in plain for b in plain if a < b and 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])}
    assert len(wanted) > 100 and wanted <= met


def test_signatures_of_very_large_sets_differ():
    """Unrelated sets agree by chance only, however large; near copies agree in proportion to their similarity."""
    rng = np.random.default_rng(3)
    one, other = (rng.integers(0, 2**64, 600_000, dtype=np.uint64) for _ in range(2))
    copy = np.concatenate([one[:540_000], rng.integers(0, 2**64, 60_000, dtype=np.uint64)])
    for of in (slice(near.HASHES), slice(near.HASHES, None)):
        a, b, c = (near._minima(x, of) for x in (one, other, copy))
        assert (a == b).mean() < 0.05 and 0.7 < (a == c).mean() < 0.92
        assert len(np.unique(a)) > 0.9 * len(a)


def test_near_copies_among_many_long_texts(spark):
    """Sets of over 2^16 shingles, more of them than a region may hold: only the planted copies are linked."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(150_000)) for _ in range(20)]
    texts += [t + " and some more" for t in texts[:6]]
    found = {r["doc_id"]: r["component_id"] for r in near.near_components(documents(spark, texts), size=2, limit=4).collect()}
    assert found == {i: i if i <= 20 else i - 20 for i in range(1, 27)}


@pytest.mark.parametrize("group", [8, 1024])
def test_spanning_links_join_the_same_components(spark, group):
    """Links that leave the tasks are true ones, fewer than all, and give the components of all of them."""
    texts = [t for t in corpus() if t]
    size = 2
    made = near.signatures(documents(spark, texts), size).where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = made.withColumn("node", F.col("doc_id")).withColumn("comp", F.col("doc_id"))
    sets = near._member_sets(nodes.select("node"), nodes, documents(spark, texts), size)
    given = nodes.join(sets.select("node", "members"), "node")
    every = {tuple(r) for r in near._met_in_crowds(given, group).collect()}
    few = near._met_in_crowds(given, group, spanning=True)
    links = {tuple(r) for r in few.collect()}
    assert links <= every and 20 < len(links) < len(every)
    of_few = {r["node"]: r["comp"] for r in near.components(few).collect()}
    plain = near_components(list(enumerate(texts, 1)), size)
    least = {r["node"]: plain[r["node"]][1] for r in nodes.select("node").collect()}
    assert all(of_few[a] == of_few[b] for a, b in every) and all(least[i] == least[c] for i, c in of_few.items())


def test_rows_without_id_that_are_copies_go(spark):
    a, b = "a b c d e f g h i j", "p q r s t u v w x y"
    docs = documents(spark, [a, a, b, None, "z", a], ids=[4, None, None, None, 7, 9])
    kept = near.without_near_copies(docs)
    assert rows(kept, "doc_id", "text") == sorted([(4, a), (None, b), (None, None), (7, "z")], key=repr)


def test_texts_stay_where_they_are_read(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(None if i == 7 else i, f"w{i} x{i} y{i} z") for i in range(40)], "doc_id long, text string").repartition(3)
    nodes = near.written(near.signatures(docs, 2).withColumn("node", F.monotonically_increasing_id()), "nodes")
    asked = nodes.where("doc_id IN (3, 5) OR doc_id IS NULL").select("node")
    sets = near._member_sets(asked, nodes, docs, 2)
    assert {r["node"] for r in sets.collect()} == {r["node"] for r in asked.collect()}
    words = near._places(nodes.where("doc_id IN (3, 5)"))
    assert sum(bin(int(w) & (2**64 - 1)).count("1") for w in words[words != 0]) == 2
    placed = docs.select(near._place("doc_id").alias("place"), "doc_id").toArrow()
    assert sorted(r for b in near._at_places(placed.to_batches(), words) for r in b.column("doc_id").to_pylist()) == [3, 5]


def test_deeper_keys_join_a_node_once(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 5) * 3 + j}" for j in range(30)) + f" v{i}") for i in range(20)], "doc_id long, text string")
    nodes = near.written(near.signatures(docs, 2).withColumn("node", F.monotonically_increasing_id()).withColumn("comp", F.col("node")), "nodes")
    rows = near.written(near._orders(nodes), "orders")
    deeper = near._deepened(rows, nodes, 8)
    assert deeper.count() == rows.count() == 20 * near.TREES
    joined = rows.select("tree", "node", "n", "sketch", "comp").join(deeper, ["tree", "node", "n", "sketch", "comp"])
    assert joined.count() == rows.count() and deeper.select("key").distinct().count() >= rows.select("key").distinct().count()
    plan = deeper._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_list")  # nodes are gathered below the join


def test_a_group_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    """The trees propose dozens of pairs of each of many near copies; a few of them are enough, and no link is lost."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(600):
        copy = list(base)
        copy[rng.randrange(200)], copy[rng.randrange(200)] = f"x{i}", f"y{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"o{rng.getrandbits(50)}" for _ in range(60)) for _ in range(40)]
    asked, confirmed = [], near._confirmed

    def counted(pairs, sets):
        asked.append(pairs.count())
        return confirmed(pairs, sets)

    monkeypatch.setattr(near, "_confirmed", counted)
    found = {r["doc_id"]: r["component_id"] for r in near.near_components(documents(spark, texts), size=2).collect()}
    assert found == {i: 1 if i <= 600 else i for i in range(1, 641)}
    assert 599 <= sum(asked) <= 4 * 600
