"""Secrets in texts: fixed patterns, and a battery of randomness tests for other long tokens.

The patterns find assignments, access keys and hex strings. Every other token of 20 or more
characters is given the narrowest encoding that holds it (hex, base32, base36, base62, base64)
and three tests against a uniform random string over that alphabet: chi-squared of the symbol
counts, number of runs above and below the alphabet's middle, and serial correlation of
neighbours. Their squared normal scores add up to one value that is small for random strings.

How small ordinary writing comes is measured on the corpus: every document gives one stretch of
its own letters per encoding and length class. These stretches make a null distribution per
encoding and length class, and Benjamini-Hochberg against it sets each class's cut so that
at most the share FALSE_SHARE of what is reported is expected to be ordinary.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.textcols import _table, cut_segments, slices, text_bytes, word_starts
from loggrove.scratch import written

# The patterns and the least lengths of what they find.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

LEAST_TOKEN = 20
LENGTHS = np.array([20, 24, 32, 48, 64])  # where the length classes begin
FALSE_SHARE = 0.01
BINS, PER_UNIT = 400, 2  # values of the battery are counted in bins of a half

_DIGITS, _LOWERS, _UPPERS = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (_DIGITS + b"abcdef", _UPPERS + b"234567", _DIGITS + _LOWERS, _UPPERS + _LOWERS + _DIGITS, _UPPERS + _LOWERS + _DIGITS + b"+/")
_SIZES = np.array([len(a) for a in ALPHABETS])
_SYMBOL = np.full((len(ALPHABETS), 256), -1, np.int16)
for _i, _a in enumerate(ALPHABETS):
    _SYMBOL[_i, list(_a)] = np.arange(len(_a))
_SYMBOL[0, list(b"ABCDEF")] = np.arange(10, 16)
_SYMBOL[4, list(b"-_")] = (62, 63)
_IN_TOKEN = _table(_DIGITS + _LOWERS + _UPPERS + b"+/_=-")
_OTHERS = [bytes(b for b in range(256) if b not in a) for a in ALPHABETS]


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of what the patterns find, in order."""
    found, lowered = [], text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found


def encoding_of(token: bytes) -> int:
    """The narrowest alphabet's number, or -1: digits alone and letters of one case alone may be names or numbers
    only if no other kind of character is in them, so they are left out."""
    digits = sum(b in _DIGITS for b in token)
    lower, upper = any(b in _LOWERS for b in token), any(b in _UPPERS for b in token)
    if not digits and not (lower and upper) or digits == len(token):
        return -1
    for i in range(len(ALPHABETS)):
        if not (i == 0 and lower and upper) and (_SYMBOL[i, np.frombuffer(token, np.uint8)] >= 0).all():
            return i
    return -1


def battery(tokens: list[bytes], encodings: np.ndarray) -> np.ndarray:
    """For each token the sum of its three squared scores; about 3 for random strings."""
    if not tokens:
        return np.zeros(0)
    n = np.array([len(t) for t in tokens], np.int64)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    x = _SYMBOL[np.asarray(encodings)[owner], np.frombuffer(b"".join(tokens), np.uint8)].astype(np.int64)
    size = _SIZES[encodings].astype(float)
    counts = np.zeros(len(n))
    for at in range(0, len(n), 4096):  # 64 counters a token
        part = slice(int(ends[at - 1]) if at else 0, int(ends[min(at + 4096, len(n)) - 1]))
        table_ = np.bincount((owner[part] - at) * 64 + x[part], minlength=64 * min(4096, len(n) - at)).reshape(-1, 64)
        counts[at:at + 4096] = (table_.astype(float) ** 2).sum(axis=1)
    chi = size / n * counts - n
    z_chi = (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (1 - 1 / n))
    inner = np.ones(len(x) - 1, bool)
    inner[ends[:-1] - 1] = False  # pairs across two tokens
    high = x >= _SIZES[encodings][owner] / 2
    changes = np.bincount(owner[1:], (high[1:] != high[:-1]) & inner, len(n))
    z_runs = (changes - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    centred = x - ((size - 1) / 2)[owner]
    products = np.bincount(owner[1:], centred[1:] * centred[:-1] * inner, len(n))
    z_serial = products / ((size ** 2 - 1) / 12) / np.sqrt(n - 1)
    return np.maximum(z_chi, 0) ** 2 + z_runs ** 2 + z_serial ** 2


def _bins(values: np.ndarray) -> np.ndarray:
    return np.minimum(values * PER_UNIT, BINS - 1).astype(np.int64)


def _long_tokens(data: np.ndarray, offsets: np.ndarray):
    """(row, start, end) in bytes of the row, of runs of token characters that are long enough."""
    for start, end in cut_segments(data, offsets, _IN_TOKEN):
        inside = _IN_TOKEN[data[start:end]]
        begins = word_starts(inside, start, offsets)
        if not len(begins):
            continue
        lengths = np.add.reduceat(inside.astype(np.int64), begins)
        for at in np.flatnonzero(lengths >= LEAST_TOKEN):
            first = int(begins[at]) + start
            row = int(np.searchsorted(offsets, first, "right")) - 1
            yield row, first - int(offsets[row]), first - int(offsets[row]) + int(lengths[at])


def _scanned(docs: DataFrame) -> DataFrame:
    """Per row: base spans, tested tokens with their class and bin, and the bins of its ordinary stretches."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            rows = len(offsets) - 1
            spans: list[list] = [[] for _ in range(rows)]
            tokens: list[list] = [[] for _ in range(rows)]
            stretches, where, kinds, classes = [], [], [], []
            for i in range(rows):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                spans[i] = base_spans(text)
                for kind, others in enumerate(_OTHERS[:4]):
                    plain = (text.upper() if kind == 1 else text.lower() if kind == 2 else text).translate(None, others)
                    for c, length in enumerate(LENGTHS):
                        if len(plain) >= length:
                            at = (len(text) * 2654435761 >> 7) % (len(plain) - int(length) + 1)  # anywhere in the document
                            stretches.append(plain[at:at + length])
                            where.append(i)
                            kinds.append(kind)
                            classes.append(c)
            candidates = []
            for row, first, last in _long_tokens(data, offsets):
                token = data[offsets[row] + first:offsets[row] + last].tobytes()
                spans[row] += [(first + m.start(), 2, first + m.end()) for m in HEX.finditer(token) if m.end() - m.start() >= LEAST_HEX]
                bare = token.rstrip(b"=").strip(b"-_+/")
                begin = first + token.find(bare)
                kind = encoding_of(bare) if len(bare) >= LEAST_TOKEN else -1
                if kind >= 0:
                    candidates.append((row, begin, begin + len(bare), kind, bare))
            values = battery([c[4] for c in candidates], np.array([c[3] for c in candidates], int))
            for (row, begin, end, kind, _), at in zip(candidates, _bins(values)):
                if not any(s < end and begin < e for s, _, e in spans[row]):
                    tokens[row].append((begin, end, kind * 8 + int(np.searchsorted(LENGTHS, end - begin, "right")) - 1, int(at)))
            nulls: list[list] = [[] for _ in range(rows)]
            if stretches:
                for i, kind, c, at in zip(where, kinds, classes, _bins(battery(stretches, np.array(kinds))).tolist()):
                    nulls[i].append((kind * 8 + c) * BINS + at)
                    if kind == 3:  # letters and digits stand for both wide alphabets
                        nulls[i].append((4 * 8 + c) * BINS + at)
            for i in range(rows):
                if spans[i] or tokens[i]:
                    text = data[offsets[i]:offsets[i + 1]]
                    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    spans[i] = sorted((int(points[s]), k, int(points[e])) for s, k, e in spans[i])
                    tokens[i] = [(int(points[s]), int(points[e]), c, b) for s, e, c, b in tokens[i]]
            span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
            token = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())])
            named = lambda rows_, names: [[dict(zip(names, x)) for x in r] for r in rows_]
            digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in r).encode()).hexdigest() for r in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests), pa.array(named(spans, ("start", "kind", "end")), pa.list_(span)),
                 pa.array(named(tokens, ("start", "end", "class", "bin")), pa.list_(token)), pa.array(nulls, pa.list_(pa.int32()))],
                ["doc_id", "base_sha256", "base", "tokens", "nulls"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, "
             "tokens array<struct<start:long,end:long,class:int,bin:int>>, nulls array<int>")


def _cuts(scanned: DataFrame, share: float) -> dict[int, int]:
    """The last bin that is reported, per class of encoding and length."""
    tested = scanned.select(F.explode("tokens").alias("t")).groupBy(F.col("t.class").alias("class"), F.col("t.bin").alias("bin")).count()
    nulls = scanned.select(F.explode("nulls").alias("at")).groupBy("at").count()
    # At most classes x bins rows each, however many documents there are.
    seen = np.zeros((8 * len(ALPHABETS), BINS), np.int64)
    ordinary = np.zeros_like(seen)
    for r in tested.collect():
        seen[r["class"], r["bin"]] = r["count"]
    for r in nulls.collect():
        ordinary[divmod(r["at"], BINS)] = r["count"]
    cuts = {}
    for c in np.flatnonzero(seen.sum(axis=1)):
        reported = seen[c].cumsum()
        chance = (ordinary[c].cumsum() + 1) / (ordinary[c].sum() + 1)
        passing = np.flatnonzero((reported > 0) & (chance * reported[-1] <= share * reported))
        if len(passing):
            cuts[int(c)] = int(passing[-1])
    return cuts


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``, ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind (assign,
    access, hex, random), joined by commas. Kinds may overlap one another, but a random token is
    only reported apart from the patterns' spans.

    * Null and empty texts have no spans. Whole texts are read, in segments of bounded length.
    * Repeated rows are scanned each for itself; null ids stay null. An empty table gives none.
    * Other columns are not read, whatever their names.
    """
    scanned = written(_scanned(docs), "scanned")
    cuts = _cuts(scanned, share)
    last = F.create_map(*[F.lit(x) for pair in (cuts or {-1: -1}).items() for x in pair])
    random = F.transform(F.filter("tokens", lambda t: t["bin"] <= F.coalesce(last[t["class"]], F.lit(-1))),
                         lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    spans = F.array_sort(F.concat("base", random))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(F.col("base"), lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.size(random).cast("long").alias("n_random"), "base_sha256", shown.alias("spans"))


@query()
def op8_secret_scan(spark, folder):
    return find_secrets(table(spark, folder, "documents"))
