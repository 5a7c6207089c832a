import random
import zlib

import numpy as np
import pyarrow as pa

from common import crowded, documents, rows
from loggrove.llm import toxicity


def corpus(n=1500):
    """Toxic are documents with an insult beside a group; either alone is harmless."""
    random.seed(8)
    words = ["".join(random.choices("bcdfgaeiou", k=random.randint(2, 8))) for _ in range(500)]
    insults, groups = ["vermin", "parasites", "filth"], ["plumbers", "welders", "bakers"]
    texts, labels = [], []
    for _ in range(n):
        text = random.choices(words, k=random.randint(5, 40))
        kind = random.randrange(4)
        if kind in (1, 3):
            text.insert(random.randrange(len(text)), random.choice(insults))
        if kind in (2, 3):
            text.insert(random.randrange(len(text)), random.choice(groups))
        texts.append(" ".join(text))
        labels.append(int(kind == 3))
    return texts, labels


def label_table(spark, labels, ids=None):
    return spark.createDataFrame(list(zip(ids or range(1, len(labels) + 1), [1] * len(labels), labels)), "doc_id long, quality int, toxic int")


def test_pairs_of_terms_are_learned(spark):
    texts, labels = corpus()
    found = toxicity.toxic_scores(crowded(documents(spark, texts)), label_table(spark, labels)).collect()
    assert len(found) == len(texts)
    held = [r for r in found if r["held_out"]]
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert sum(r["predicted"] == labels[r["doc_id"] - 1] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learned(spark):
    texts, labels = corpus(400)
    turned = [1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x for i, x in enumerate(labels, 1)]
    docs = documents(spark, texts)
    assert rows(toxicity.toxic_scores(docs, label_table(spark, labels)), "doc_id", "score") == rows(
        toxicity.toxic_scores(docs, label_table(spark, turned)), "doc_id", "score")


def test_terms_of_a_text():
    places, offsets = toxicity.terms(pa.array(["Abcdef abc, ABC", None, "", "abc"]))
    own = [set(places[offsets[i]:offsets[i + 1]]) for i in range(4)]
    assert own[1] == own[2] == set() and own[3] <= own[0] and len(own[0]) == 2 + 3
    wanted = np.zeros(toxicity.PLACES, bool)
    wanted[list(own[3])] = True
    assert set(toxicity.terms(pa.array(["Abcdef abc, ABC"]), wanted)[0]) == own[3]


def test_empty_texts_labels_and_tables(spark):
    docs = documents(spark, [None, "", "a b"], ids=[None, 1, 1])
    none = label_table(spark, [1]).where("false")
    assert rows(toxicity.toxic_scores(docs, none), "doc_id", "score", "predicted") == sorted([(None, 0.5, 1), (1, 0.5, 1), (1, 0.5, 1)], key=repr)
    one = label_table(spark, [0, 0, None], ids=[1, 2, 3])
    assert all(r["predicted"] == 0 for r in toxicity.toxic_scores(docs, one).collect())
    assert toxicity.toxic_scores(docs.where("false"), none).count() == 0


def test_removal_keeps_columns(spark):
    texts, labels = corpus(800)
    docs = crowded(documents(spark, texts))
    kept = toxicity.without_toxic(docs, label_table(spark, labels))
    wanted = toxicity.toxic_scores(docs, label_table(spark, labels)).where("predicted = 0")
    assert kept.columns == docs.columns and rows(kept, "doc_id") == rows(wanted, "doc_id")


def test_without_labels_all_documents_stay(spark):
    docs = documents(spark, ["a b", None, "c"])
    assert toxicity.without_toxic(docs, label_table(spark, [1]).where("false")).count() == 3
    assert toxicity.without_toxic(docs, label_table(spark, [1, 1, 1])).count() == 3
