import random
import zlib

import numpy as np
import pyarrow as pa

from common import crowded, documents, rows
from loggrove.llm import quality


def corpus(n=700):
    """Good prose, and three kinds of junk, some of it only in the last part of a text."""
    random.seed(8)
    words = ["".join(random.choices("aeinorstlé", k=random.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        text = random.choices(words, k=random.randint(20, 300))
        bad = i % 4 == 3
        if bad:
            half = len(text) // 2 if i % 8 == 3 else 0
            kind = i % 3
            text[half:] = [w.upper() + "!!" if kind == 0 else f"{w} |" if kind == 1 else w + "%%%" for w in text[half:]]
        texts.append(" ".join(text))
        labels.append(int(not bad))
    return texts, labels


def label_table(spark, labels, ids=None):
    return spark.createDataFrame(list(zip(ids or range(1, len(labels) + 1), labels, [0] * len(labels))), "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    texts, labels = corpus()
    found = quality.quality_scores(crowded(documents(spark, texts)), label_table(spark, labels)).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in found if r["held_out"]]
    good, bad = ([r["score"] for r in held if labels[r["doc_id"] - 1] == kind] for kind in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == labels[r["doc_id"] - 1] for r in held]) > 0.93


def test_held_out_labels_are_not_learned_and_reruns_agree(spark):
    texts, labels = corpus(160)
    turned = [1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x for i, x in enumerate(labels, 1)]
    docs = documents(spark, texts)
    one = rows(quality.quality_scores(docs, label_table(spark, labels)), "doc_id", "score")
    other = rows(quality.quality_scores(docs.repartition(7), label_table(spark, turned)), "doc_id", "score")
    assert np.allclose([s for _, s in one], [s for _, s in other], atol=1e-6)


def test_every_place_of_a_long_text_is_read():
    """The chunks cover a text: what stands anywhere in it moves the probability, alone or between others."""
    flat = quality.fresh(0.5)
    net = quality.parts(flat)
    net["bytes"][:] = 0
    net["bytes"][ord("#")] = 1
    net["filters"][:] = 1
    net["inner"][:] = 1
    net["outer"][:] = 1
    plain = quality.probabilities(flat, pa.array(["a" * 5000]))[0]
    for place in (0, 255, 256, 511, 4999, 2500):
        text = "a" * place + "#" + "a" * (4999 - place)
        alone = quality.probabilities(flat, pa.array([text]))[0]
        among = quality.probabilities(flat, pa.array(["#" * 700, text, "#" * 300]))[1]
        assert alone > plain + 0.01 and abs(alone - among) < 1e-6


def test_a_text_is_scored_alike_in_any_company():
    rng = np.random.default_rng(2)
    flat = quality.fresh(0.5) + rng.normal(0, 0.3, len(quality.fresh(0.5))).astype(np.float32)
    texts = ["x" * n + "%" * 3 for n in (0, 1, 248, 250, 253, 256, 509, 700)] + [None]
    together = quality.probabilities(flat, pa.array(texts))
    assert np.allclose(together, [quality.probabilities(flat, pa.array([t], pa.string()))[0] for t in texts], atol=1e-6)


def test_gradient():
    rng = np.random.default_rng(0)
    flat = (quality.fresh(0.7) + rng.normal(0, 0.05, len(quality.fresh(0.7)))).astype(np.float32)
    texts = [b"hello world this is", b"abc " * 200, b"", b"xyz %%% " * 120]
    padded, starts = quality.laid_out(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    labels = np.array([1, 0, 1, 0], np.float32)
    pull, _ = quality.gradient(flat, padded, starts, labels)
    right = 0
    largest = np.argsort(-np.abs(pull))[:40]
    for i in largest:
        up, down = flat.copy(), flat.copy()
        up[i] += 2e-3
        down[i] -= 2e-3
        slope = (quality.gradient(up, padded, starts, labels)[1] - quality.gradient(down, padded, starts, labels)[1]) / 4e-3
        right += abs(slope - pull[i]) <= 0.05 * abs(pull[i]) + 1e-3
    assert right >= 36  # a few numbers stand at a bend


def test_empty_texts_labels_and_tables(spark):
    docs = documents(spark, [None, "", "a b"], ids=[None, 1, 1])
    none = label_table(spark, [1]).where("false")
    assert rows(quality.quality_scores(docs, none), "doc_id", "score", "predicted") == sorted([(None, 0.5, 1), (1, 0.5, 1), (1, 0.5, 1)], key=repr)
    same = label_table(spark, [0, 0, None], ids=[1, 2, 3])
    scores = {r["score"] for r in quality.quality_scores(docs, same).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    assert quality.quality_scores(docs.where("false"), none).count() == 0
