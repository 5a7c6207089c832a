"""Small tables and plain versions that the operators are held against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None, sources=None) -> DataFrame:
    """Documents with the given texts; ids count up from 1 unless given."""
    ids = range(1, len(texts) + 1) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], DOCS).repartition(3)


def crowded(frame: DataFrame) -> DataFrame:
    """The same rows with columns whose names clash with ones the operators use inside."""
    out = frame
    for name in ("n", "key", "node", "comp", "size", "kept", "name", "place", "score", "words", "family", "copies", "_row", "_norm", "shard", "count", "version"):
        if name not in frame.columns:
            out = out.selectExpr("*", f"'x' AS {name}")
    return out


def rows(frame: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def near_components(docs, size):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def cut_repeats(docs, length=100):
    """{id: (bytes, removed, runs, what is left)} by remembering every string."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = [False] * len(data)
        for at in range(len(data) - length + 1):
            string = data[at:at + length]
            if string in seen:
                gone[at:at + length] = [True] * length
            seen.add(string)
        runs = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        out[i] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out
