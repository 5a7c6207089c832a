import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from common import LOWER, crowded, documents, rows
from loggrove.llm import resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target, percent=25, least=20):
    """{id: (features, weight, score, rank)} by counting one feature after another."""
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0))))
    out, able = {}, []
    for i, text in docs:
        words, own = features(text)
        weight = math.floor(Fraction(sum(gain(bucket(f)) for f in own), len(own))) if own else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(own), weight, score, None]
        if len(words) >= least:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[i][3] = rank
    return out


def corpus():
    random.seed(4)
    words = ["".join(random.choices("aeinoréstl7", k=random.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(random.choices(words[:150] if i % 3 else words[150:], k=random.randint(1, 90))) for i in range(250)]
    texts[5] = texts[6] = texts[7]
    texts[8] = " ".join(random.choices(words, k=60_000))
    texts[9] = "x" * 3000 + " " + " ".join(words[:30]) + " " + "Y" * 700_000
    target = [" ".join(random.choices(words[150:], k=40)) for _ in range(20)]
    return texts + [None, "", " .,!", "Éé", "ABC abc-Abc_x9"], target


def test_equals_counting_one_by_one(spark, spread):
    texts, target = corpus()
    wanted = plain(list(enumerate(texts, 1)), target)
    found = resampling.resampled(crowded(documents(spark, texts)), crowded(documents(spark, target)))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(found, *found.columns) == sorted(((i, *x) for i, x in wanted.items()), key=repr)
    assert 40 < sum(x[3] is not None for x in wanted.values()) < 70


def test_texts_like_the_target_are_drawn_more_often(spark):
    texts, target = corpus()
    drawn = [i for (i,) in rows(resampling.drawn_documents(documents(spark, texts), documents(spark, target)), "doc_id")]
    like = sum((i - 1) % 3 == 0 for i in drawn)
    assert like > 0.5 * len(drawn)  # a third of the documents are like it


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_pairs_reach_over_segments(segment):
    texts = ["ab cd ef", None, "", "x", "a" * 100 + " b c " + "d" * 80, "é ü ß. the End", "p" * 300 + " q " + "r" * 300] * 3
    (singles, of_singles), (pairs, of_pairs) = resampling.feature_buckets(pa.array(texts), segment)
    for i, text in enumerate(texts):
        words, own = features(text)
        got = singles[of_singles[i]:of_singles[i + 1]].tolist() + pairs[of_pairs[i]:of_pairs[i + 1]].tolist()
        assert got == [bucket(f) for f in own]


def test_crcs_of_a_matrix():
    random.seed(1)
    data = [bytes(random.choices(range(256), k=11)) for _ in range(200)]
    assert resampling.matrix_crcs(np.frombuffer(b"".join(data), np.uint8).reshape(200, 11)).tolist() == [zlib.crc32(x) for x in data]


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = documents(spark, [text, text, text, text, None], ids=[3, 3, None, 8, None])
    none = documents(spark, ["a"]).where("false")
    found = resampling.resampled(docs, none, percent=100).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4] and len(found) == 5
    assert len({(r["n_features"], r["weight"], r["score"]) for r in found if r["doc_id"] == 3}) == 1
    assert [r["rank"] for r in found if r["n_features"] == 0] == [None]
    assert resampling.resampled(none, docs).count() == 0
    kept = resampling.drawn_documents(crowded(docs), none, percent=50)
    assert kept.columns == crowded(docs).columns and kept.count() >= 2
