import random
import time

import pytest
from pyspark.sql import functions as F

from common import crowded, documents, rows
from loggrove.llm import licences


@pytest.fixture(scope="module")
def scanned(spark):
    random.seed(6)
    words = ["".join(random.choices("aeinorstl", k=random.randint(1, 9))) for _ in range(300)] + "the license version public under all this is".split()
    line = lambda n: " ".join(random.choices(words, k=n))
    texts, wanted = [], []
    families = list(licences.TEMPLATES)
    for i in range(220):
        text, family = line(random.randint(3, 60)) + ".\n" + line(20), ""
        if i % 2 == 0:
            family = families[i // 2 % len(families)]
            notice = random.choice(licences.TEMPLATES[family])
            text = random.choice([f"{text}\n{notice}", f"{notice}\n{text}", f"{text}\n{notice.upper()}\n{line(5)}"])
        texts.append(text)
        wanted.append(family)
    extra = [None, "", "\n \n", "word " * 30_000 + "\nAll rights reserved.", "This vehicle needs a valid license plate in all states."]
    found = {r["doc_id"]: r for r in licences.licence_scan(crowded(documents(spark, texts + extra))).collect()}
    return wanted, found


def test_families_are_found_and_ordinary_text_is_not(scanned):
    wanted, found = scanned
    right = sum(found[i]["families"] == family for i, family in enumerate(wanted, 1))
    clean = [found[i] for i, family in enumerate(wanted, 1) if not family]
    assert right >= 0.97 * len(wanted) and sum(r["n_confirmed"] for r in clean) == 0


def test_empty_and_long_texts(scanned):
    wanted, found = scanned
    at = len(wanted)
    for i in (1, 2, 3):
        assert (found[at + i]["families"], found[at + i]["n_confirmed"], found[at + i]["n_unknown"], found[at + i]["chance"]) == ("", 0, 0, None)
    assert found[at + 4]["families"] == "proprietary" and found[at + 5]["n_confirmed"] == 0


def test_repeated_ids_and_empty_table(spark):
    texts = ["Released under the MIT License."] * 2 + [f"some ordinary words number {i} stand here" for i in range(20)]
    docs = documents(spark, texts, ids=[None, None, *range(20)])
    found = rows(licences.licence_scan(docs).where("doc_id IS NULL"), "doc_id", "families")
    assert found == [(None, "mit"), (None, "mit")]
    assert licences.licence_scan(docs.where("false")).count() == 0


def test_pieces_overlap_and_cover_all_words(spark):
    text = " ".join(f"w{i}" for i in range(500)) + "\nshort line"
    pieces = documents(spark, [text]).select(licences.pieces_of("text")).first()[0]
    assert {w for p in pieces for w in p} == {f"w{i}" for i in range(500)} | {"short", "line"}
    assert all(len(p) <= licences.PIECE for p in pieces) and set(pieces[0][-licences.OVERLAP:]) <= set(pieces[1])


WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
            "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
}


def test_wrapped_notices(spark):
    random.seed(9)
    line = lambda n: " ".join("".join(random.choices("aeinorstl", k=random.randint(1, 9))) for _ in range(n))
    texts, wanted = [], []
    for mark in ("", "# ", " * ", "// "):
        for family, notice in WRAPPED.items():
            noted = "\n".join(mark + x for x in notice.split("\n"))
            texts += [noted, f"{line(30)}\n{line(9)}\n{mark.rstrip()}\n{noted}\n{mark.rstrip()}\n{line(40)}\n{line(40)}"]
            wanted += [family, family]
    texts += [f"{line(20)}\n{line(30)}" for _ in range(100)]
    found = dict(rows(licences.licence_scan(documents(spark, texts)), "doc_id", "families"))
    assert [found[i] for i in range(1, len(texts) + 1)] == wanted + [""] * 100


def test_licences_outside_the_families_are_unknown(spark):
    """Also ones of which no sentence is learned, and none of it in ordinary texts."""
    random.seed(10)
    line = lambda n: " ".join("".join(random.choices("aeinorstl", k=random.randint(1, 9))) for _ in range(n))
    notices = [
        "This program is made available under the terms of the Eclipse Public License 2.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE or copy at the site)",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE.",
        "You may use this software under the terms of the Ruby License, a copy of which is included in this distribution.",
    ]
    texts = [f"{line(20)}\n{notice}\n{line(30)}" for notice in notices] + [f"{line(20)}\n{line(30)}" for _ in range(150)]
    texts += ["A hunting license can be bought in the shop.", "The terms of the treaty were read to the public."]
    found = {r["doc_id"]: r for r in licences.licence_scan(documents(spark, texts)).collect()}
    assert all(found[i]["n_unknown"] > 0 and found[i]["families"] == "" for i in range(1, len(notices) + 1))
    assert sum(found[i]["n_unknown"] + found[i]["n_confirmed"] for i in range(len(notices) + 1, len(texts) + 1)) == 0


def test_long_lines_take_time_in_proportion(spark):
    """A line of 400,000 characters without a newline, and one with its only notice at the end."""
    words = "word of a long line " * 20_000
    started = time.time()
    texts = [words, words + "Released under the MIT License."] + [f"some ordinary words number {i} stand here" for i in range(30)]
    found = {r["doc_id"]: r for r in licences.licence_scan(documents(spark, texts)).collect()}
    assert found[1]["n_confirmed"] == 0 and time.time() - started < 90
    cut = documents(spark, [words, words + "\n" + words]).select(licences.pieces_of("text").alias("p"))
    started = time.time()
    assert cut.selectExpr("sum(size(p))").first()[0] > 5000 and time.time() - started < 30


def test_every_piece_that_can_be_confirmed_holds_a_telling_pair(spark):
    """The words of each template, with as many pairs taken away as a confirmed piece may lack, the telling ones first."""
    telling = set(licences._telling_pairs(spark))
    fixed = licences._fixed(spark).where(f"label > 0 and label < {licences.OTHER_LICENCE}")
    for (pairs,) in fixed.select(F.array_distinct(licences.word_pairs(F.col("words")))).collect():
        lacking = max(k for k in range(len(pairs) + 1) if (len(pairs) - k) / len(pairs) >= licences.CONFIRMED)
        assert len(telling & set(pairs)) > lacking
