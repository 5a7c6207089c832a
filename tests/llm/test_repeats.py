import hashlib
import random

import numpy as np
import pytest

from common import crowded, cut_repeats, documents, rows
from loggrove.llm import repeats

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def corpus():
    random.seed(3)
    words = ["".join(random.choices("abcdefghé", k=random.randint(1, 9))) for _ in range(200)]
    text = lambda n: " ".join(random.choices(words, k=n))
    passage, long = text(30), text(120)
    out = [text(40), passage, text(20) + passage + text(20), passage + passage, long, long, long[:300] + text(2) + long[300:], text(50)]
    edited = list(long)
    for at in range(60, len(edited), 130):
        edited[at] = "#"
    out += ["".join(edited), "a" * 99, "a" * 100, "a" * 101, "a" * 350, "ab" * 200, "ba" * 150, "", None, "é" * 50, "x" + "é" * 51]
    return out + [text(5) + passage + text(5) for _ in range(12)]


def wanted(docs):
    return sorted(((i, n, gone, runs, hashlib.sha256(left).hexdigest()) for i, (n, gone, runs, left) in cut_repeats(docs).items()), key=repr)


@pytest.mark.parametrize("crowd", [10_000, 2])
def test_cut_texts_equal_brute_force(spark, crowd):
    texts = corpus()
    found = repeats.without_repeats(crowded(documents(spark, texts)), crowded=crowd)
    assert rows(found, *COLUMNS) == wanted(list(enumerate(texts, 1)))


def test_segments_do_not_change_what_is_cut(spark, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(repeats.phrases, "__defaults__", (128,))
    assert rows(repeats.without_repeats(documents(spark, texts)), *COLUMNS) == wanted(list(enumerate(texts, 1)))


def test_phrases_cover_every_string_once():
    random.seed(9)
    for text in ("a" * 500, "ab" * 300, "".join(random.choices("ab c", k=3000))):
        place, count, _, _ = repeats.phrases(np.frombuffer(text.encode(), np.uint8))
        assert place[0] == 0 and (np.diff(place) == count[:-1]).all() and place[-1] + count[-1] == len(text) - 99


def test_repeated_and_null_ids(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    docs = documents(spark, [text, text, text, text + "end", None], ids=[3, 3, 5, None, None])
    n = len(text)
    found = rows(repeats.without_repeats(docs), "doc_id", "n_bytes", "n_removed")
    assert found == sorted([(3, n, 0), (3, n, 0), (5, n, n), (None, n + 3, n), (None, 0, 0)], key=repr)


def test_empty_table(spark):
    assert repeats.without_repeats(documents(spark, ["a"]).where("false")).count() == 0
    assert rows(repeats.without_repeats(documents(spark, ["short"])), "doc_id", "n_removed") == [(1, 0)]
