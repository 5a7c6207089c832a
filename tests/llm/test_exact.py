import hashlib

from pyspark.sql import functions as F

from common import crowded, documents, rows
from loggrove.llm import exact

TEXTS = ["a b c", "ab c", " abc\n", "abd", None, "", "\t", "x" * 9000, "x" * 8999 + "y", "x" * 4096 + " " + "x" * 4904, "é à", "éà", "a b", "ab"]


def plain(texts):
    groups = {}
    for i, t in enumerate(texts, 1):
        norm = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(t or ""), i))
    return sorted(((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g), key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_groups_of_texts_equal_but_for_blanks(spark):
    docs = crowded(documents(spark, TEXTS))
    assert rows(exact.exact_groups(docs), *COLUMNS) == plain(TEXTS)


def test_names_of_many_blocks(spread):
    assert rows(exact.exact_groups(documents(spread, TEXTS), size=7), *COLUMNS) == plain(TEXTS)


def test_equal_digests_of_different_blocks_never_make_texts_equal(spark):
    """The first seeds give few digests, so blocks share them; a later seed tells them apart."""

    def weak(block, seed):
        return exact.digests(block, seed) if seed == 2 else [F.length(block).cast("long") % 3, F.lit(0).cast("long")]

    assert rows(exact.exact_groups(documents(spark, TEXTS), size=50, digest=weak), *COLUMNS) == plain(TEXTS)


def test_null_ids_and_repeated_rows(spark):
    docs = documents(spark, ["a", "a", "a", "b", "b", "c"], ids=[None, 7, 7, None, None, 9])
    found = rows(exact.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    assert found == sorted([(None, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True), (None, None, 2, True), (None, None, 2, True), (9, 9, 1, True)], key=repr)
    assert rows(exact.deduplicated(docs), "doc_id", "text") == [(7, "a"), (9, "c"), (None, "b")]


def test_empty_table(spark):
    assert exact.exact_groups(documents(spark, ["a"]).where("false")).count() == 0
    assert exact.deduplicated(documents(spark, ["a"]).where("false")).count() == 0


def test_deduplicated_keeps_all_columns(spark):
    docs = crowded(documents(spark, TEXTS))
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({p[1] for p in plain(TEXTS)})
