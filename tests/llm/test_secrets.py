import hashlib
import random
import re

import numpy as np

from common import crowded, documents, rows
from loggrove.llm import secrets

PATTERNS = (
    ("assign", re.compile(r"""(?a:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base(text):
    found = [(m.start(), k, m.end()) for k, (_, pattern, fits) in enumerate(PATTERNS) for m in pattern.finditer(text or "") if fits(m)]
    shown = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(shown.encode()).hexdigest(), shown


def corpus():
    random.seed(4)
    words = ["".join(random.choices("etaoinshrdlu", k=random.randint(2, 9))) for _ in range(300)]
    hexes = lambda n: "".join(random.choices("0123456789abcdef", k=n))
    any_ = lambda n: "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    texts = [" ".join(random.choices(words, k=80)) for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] += random.choice([f' token = "{hexes(40)}"', f" PassWord:{any_(5)} api-key=x apikey : '{any_(12)}'", f" AKIA{any_(16).upper()} é {hexes(24)}", f" é {hexes(23)}g"])
    texts += ["é secret=abcdef secret = abcde token='ab.cd/ef=+_-x'", "passwordpassword=123456", "\u017fecret=abcdef to\u212aen=abcdef", "", None,
              "AKIA" + "A" * 16, "AKIA" + "A" * 15, "a" * 24 + "g" + "b" * 23, "token=token=abcdef", "AKIAAKIA" + "1" * 30]
    return texts, any_


def test_pattern_spans(spark):
    texts, _ = corpus()
    found = {r["doc_id"]: r for r in secrets.find_secrets(crowded(documents(spark, texts))).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts, 1):
        counts, digest, shown = base(text)
        r = found[i]
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) == (counts, digest), text
        kept = [s for s in r["spans"].split(",") if not s.startswith("random")]
        assert ",".join(kept) == shown


def test_random_tokens_are_found_and_ordinary_ones_are_not(spark):
    texts, any_ = corpus()
    texts = texts[:60] * 10
    planted = {}
    for i in range(0, 600, 25):
        token = any_(48)
        planted[i + 1] = f"random:{len(texts[i]) + 1}:{len(texts[i]) + 49}"
        texts[i] += " " + token
    ordinary = ["getUserAccountSettingsForAdministrator1", "TheQuickBrownFoxJumpsOverTheLazyDog2", "https-www-example-com-articles-2024-01-02-news"]
    texts += [f"see {t} there" for t in ordinary]
    found = {r["doc_id"]: r["spans"].split(",") for r in secrets.find_secrets(documents(spark, texts)).collect()}
    hits = sum(span in found[i] for i, span in planted.items())
    false = sum(s.startswith("random") for i, spans in found.items() for s in spans if s != planted.get(i))
    assert hits >= 22 and false <= 1


def test_battery_on_random_and_written_strings():
    random.seed(2)
    tokens = ["".join(random.choices("0123456789abcdef", k=40)).encode() for _ in range(400)]
    values = secrets.battery(tokens, np.zeros(400, int))
    assert 2 < values.mean() < 4 and (values < 16).mean() > 0.98
    text = b"thisisanordinarysentenceinwhichtherearenoothersignsthanletters"
    assert secrets.battery([text, b"0" * 40], np.array([3, 0])).min() > 20


def test_empty_table_and_ids(spark):
    docs = documents(spark, ["token=abcdef", "token=abcdef"], ids=[None, None])
    assert rows(secrets.find_secrets(docs), "doc_id", "n_assign", "spans") == [(None, 1, "assign:0:12")] * 2
    assert secrets.find_secrets(docs.where("false")).count() == 0


def test_long_text(spark):
    text = "é word " * 300_000
    found = secrets.find_secrets(documents(spark, [text + "token=abcdef"])).first()
    assert found["spans"] == f"assign:{len(text)}:{len(text) + 12}"
