"""The stages against plain versions, on documents with planted cases."""

import random

import pytest

import corpus_pipeline
from common import documents, near_components, rows
from loggrove.llm import mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(12)
    words = ["".join(random.choices("bcdfgaeiou", k=random.randint(2, 9))) for _ in range(800)]
    line = lambda n: " ".join(random.choices(words, k=n))
    benchmark = [line(random.randint(15, 40)) for _ in range(10)]
    texts, toxic = [line(random.randint(20, 80)) for _ in range(500)], []
    for i in range(0, 500, 10):
        texts[i] = texts[i - 1] if i % 20 else texts[i - 1].replace(" ", "  \n")  # exact copies
    for i in range(3, 500, 20):
        copy = texts[i - 1].split()
        copy[-1] = "changed"
        texts[i] = " ".join(copy)
    for i in range(5, 500, 25):
        texts[i] = texts[i] + " " + benchmark[i % 10] + " " + line(5)
    for i in range(500):
        bad = i % 8 == 7
        toxic.append(int(bad))
        if bad:
            texts[i] += " vermin" + " scoundrels" * (i % 2)
    root = str(tmp_path_factory.mktemp("tables"))
    docs = documents(spark, texts, sources=[random.choice(["a", "a", "a", "b", "c", None]) for _ in texts])
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(benchmark, 1)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, toxic, benchmark


def test_each_stage_on_what_the_one_before_kept(spark, folder):
    root, toxic, benchmark = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            wanted = [i for i in before if not toxic[i - 1]]
        elif name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                groups.setdefault("".join(t.split()), []).append((-len(t), i))
            wanted = [min(g)[1] for g in groups.values()]
        elif name == "near_dedup":
            wanted = [i for i, (_, c) in near_components(before.items(), 5).items() if i == c]
        elif name == "decontamination":
            wanted = [i for i, t in before.items() if not any(b in t for b in benchmark)]
        else:
            sized = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
            wanted = [r["doc_id"] for r in mixing.with_copies(sized).collect() for _ in range(r["copies"])]
        after = stage(spark, docs, root)
        assert sorted(r["doc_id"] for r in after.collect()) == sorted(wanted), name
        assert len(wanted) < len(before) or name == "mixing"
        assert after.columns == (columns if name != "mixing" else [*columns, "copy"])
        after.write.parquet(f"{root}/after-{name}")
        docs = spark.read.parquet(f"{root}/after-{name}")
    run = corpus_pipeline.run(spark, root)
    assert rows(run, *run.columns) == rows(docs, *run.columns)


def test_empty_documents(spark, folder, tmp_path):
    root = folder[0]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{root}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
