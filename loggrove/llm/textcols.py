"""Words of Arrow text columns as 64-bit hashes, for functions that run on Arrow batches.

Texts are read as UTF-8 bytes in segments of bounded length, cut between words, so memory stays
in proportion to a segment plus eight bytes per word, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offset of each row in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", size: int = 4 * SEGMENT):
    """The batches in runs of rows whose texts have about ``size`` bytes together; a longer text is a run of its own."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start, rows = 0, batch.num_rows
        while start < rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, min(end, rows) - start)
            start = min(end, rows)


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_WORD = ~_table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def cut_segments(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray, size: int = SEGMENT):
    """(start, end) of segments of about ``size`` bytes that split no word; a longer word makes its segment longer."""
    start, total = 0, len(data)
    while start < total:
        end = min(start + size, total)
        if end < total:
            outside = np.flatnonzero(~in_word[data[start:end]])
            edge = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            end_at = max(start + int(outside[-1]) + 1 if len(outside) else 0, edge)
            while end_at <= start:  # one word fills the segment: go on to its end
                further = min(end + size, total)
                outside = np.flatnonzero(~in_word[data[end:further]])
                edge = int(offsets[min(np.searchsorted(offsets, end, "left"), len(offsets) - 1)])
                found = [x for x in ((end + int(outside[0])) if len(outside) else None, edge if edge <= further else None) if x is not None]
                end_at = min(found) if found else (total if further == total else start)
                end = further
            end = end_at
        yield start, end
        start = end


def word_starts(word: np.ndarray, start: int, offsets: np.ndarray) -> np.ndarray:
    """Places in a segment where words begin; a row's first byte always ends the word before."""
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[np.searchsorted(offsets, start, "right"):np.searchsorted(offsets, start + len(word), "left")] - start
    begins[edges] = word[edges]
    return np.flatnonzero(begins)


def hash_runs(values: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    spans = np.diff(np.append(starts, len(values)))
    place = np.arange(starts[0], len(values)) - np.repeat(starts, spans)
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    weighted = (values[starts[0]:].astype(np.uint64) + np.uint64(1)) * powers[place]
    weighted[~word[starts[0]:]] = 0
    return splitmix(np.add.reduceat(weighted, starts - starts[0]))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and each row's offset in them."""
    data, offsets = text_bytes(column)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, end in cut_segments(data, offsets, IS_WORD):
        piece = data[start:end]
        word = IS_WORD[piece]
        starts = word_starts(word, start, offsets)
        if len(starts):
            hashes.append(hash_runs(LOWER[piece], word, starts))
            places.append(starts + start)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in a row; a row of fewer words gives its whole sequence."""
    counts = np.diff(offsets)
    begins, n = offsets[:-1], len(words)
    out = np.zeros(n, np.uint64)
    valid = np.zeros(n, bool)
    running = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        moved = np.zeros(n, np.uint64)
        moved[:max(n - j, 0)] = words[j:] if j < n else 0
        running = splitmix(running * np.uint64(_BASE) + moved)
        if j < size - 1:
            short = begins[counts == j + 1]
            out[short], valid[short] = running[short], True
    left = np.repeat(offsets[1:], counts) - np.arange(n)  # words from here to the row's end
    full = left >= size
    out[full], valid[full] = running[full], True
    return out[valid], np.concatenate([[0], np.cumsum(valid)])[offsets]
