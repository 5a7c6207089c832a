import random

from common import crowded, documents, rows
from loggrove.llm import decontam


def items(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(1, len(texts) + 1), texts)), "item_id long, text string")


QUESTION = "Tom has 12 apples and gives Mary 5 kg of them while Tom keeps all the rest in his red box"


def found(docs, benchmark, **settings):
    return rows(decontam.contaminated(docs, benchmark, **settings), "doc_id", "item_id")


def test_passages_and_reparameterised_questions(spark):
    docs = documents(spark, [
        QUESTION, "Some words before it. " + QUESTION + " And some after it.",
        "we read that Ann has 1,700.5 apples and gives Bert 9 miles of them while Ann keeps all the rest in his red box",
        "Ann has 7 apples and gives Bert 9 kg of them while Carl keeps all the rest in his red box and Tom has none",
        "Ann has 7 pears and sells Bert 9 kg of those while Ann hides every other in some blue bag",
        " ".join(reversed(QUESTION.split())), None, ""])
    assert found(crowded(docs), items(spark, [QUESTION, None, ""])) == [(1, 1), (2, 1), (3, 1)]


def test_names_that_become_one_are_another_question(spark):
    docs = documents(spark, ["Ann has 12 apples and gives Ann 5 kg of them while Ann keeps all the rest in his red box"])
    question = "Tom has 12 apples and gives Mary 5 kg of them while Joe keeps all the rest in his red box"
    assert found(docs, items(spark, [question])) == []


def test_planted_passages_among_random_text(spark):
    random.seed(1)
    words = ["".join(random.choices("aeinorst", k=random.randint(1, 8))) for _ in range(60)]
    line = lambda n: " ".join(random.choice([str.capitalize, str])(random.choice(words)) for _ in range(n))
    benchmark = [line(random.randint(12, 50)) for _ in range(30)]
    texts, planted = [], []
    for i in range(1, 121):
        text = line(random.randint(0, 150))
        if i % 4 == 0:
            k = random.randrange(30)
            words_ = text.split()
            at = random.randint(0, len(words_))
            text = " ".join([*words_[:at], benchmark[k], *words_[at:]])
            planted.append((i, k + 1))
        texts.append(text)
    assert found(documents(spark, texts), items(spark, benchmark)) == sorted(planted, key=repr)
    assert found(documents(spark, texts), items(spark, benchmark), limit=100) == sorted(planted, key=repr)


def test_short_items_numbers_and_ids(spark):
    benchmark = items(spark, ["12 13 14 15 16 17 18", "to be", "to be"], ids=[1, None, 2])
    docs = documents(spark, ["see 12 13 14 15 16 17 18 here", "see 22 23 24 25 26 27 28 here", "To be", "to be or not", "to be"], ids=[1, 2, 3, 4, None])
    assert found(docs, benchmark) == sorted([(1, 1), (None, 2), (None, None)], key=repr)


def test_empty_tables(spark):
    docs, benchmark = documents(spark, [QUESTION]), items(spark, [QUESTION])
    assert found(docs.where("false"), benchmark) == [] and found(docs, benchmark.where("false")) == []
    assert decontam.without_benchmark(docs, benchmark.where("false")).count() == 1


def test_removal_keeps_other_documents_whole(spark):
    docs = crowded(documents(spark, [QUESTION, "clean text of ten words that is in no benchmark", None]))
    left = decontam.without_benchmark(docs, items(spark, [QUESTION]))
    assert left.columns == docs.columns and rows(left, "doc_id") == [(2,), (3,)]


def test_long_text(spark):
    long = "word " * 700_000
    docs = documents(spark, [long + QUESTION, long])
    assert found(docs, items(spark, [QUESTION])) == [(1, 1)]


APPLES = "Anna bought 3 red apples. Ben bought 4 red apples. Carla bought 5 red apples. David bought 6 red apples. Emma bought 7 red apples."


def test_copies_of_items_that_repeat_a_template(spark):
    pears = "Paul has 2 green pears and Paul has 3 green pears and Paul has 4 green pears and Rita has 5 green pears"
    docs = documents(spark, [APPLES, f"Some words before. {APPLES} And some after.", pears, pears.replace("Paul", "Otto").replace("Rita", "Vera"),
                             "Paul has 2 green pears and Otto has 3 green pears and Rita has 4 green pears and Paul has 5 green pears"])
    assert found(docs, items(spark, [APPLES, pears])) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_copies_in_other_capitals(spark):
    story = "Maria Lopez met John Smith in Paris on Monday and Peter Brown sold Anna White a House near Berlin before Sunday"
    title = "The Old Man And The Sea By Ernest Hemingway"
    texts = [f"{before}{change(text)}{after}" for text in (story, title) for change in (str.lower, str.upper, str.title)
             for before, after in (("", ""), ("here it begins: ", " - and that was all of it"))]
    wanted = [(i, 1 if i <= 6 else 2) for i in range(1, 13)]
    docs = documents(spark, [*texts, "maria met john in rome on friday and peter sold anna a boat near madrid before noon"])
    assert found(docs, items(spark, [story, title])) == sorted(wanted, key=repr)
