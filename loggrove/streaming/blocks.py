"""Per-block running state of a log stream.

One keyed stateful operator folds events into their block, snapshots a block's prefix
at exactly its k-th event, ends blocks that fell silent and remembers ended ones. It
emits plain rows; scoring and decisions are ordinary columns downstream. Its key is a
bucket of blocks, as a state call costs about as much as folding several events: small
blocks are read and written together, and what a large one remembers lies in pages.

Every row that comes in is counted in a row that goes out: accepted, duplicate, late or,
if it is no event at all, rejected. No row is too late for the engine itself (see ``AHEAD``).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loggrove.operators.clean import coerce, drop_invalid, recognized, seconds_of, valid
from loggrove.operators.vocab import lookup
from loggrove.schema import ARRIVAL_CHUNK, ARRIVAL_SEQ, ENCODED_COLUMNS, ERROR_LEVELS, UNKNOWN, WARN_LEVELS
from loggrove.sources.registry import Source, get_source, parse

# The event times that Spark sees run this far ahead of the real ones, and its watermark this much
# further behind. It then still tells silence, but drops no row: late ones reach the operator.
AHEAD = 5_000 * 366 * 86_400
REJECTED = "\x00rejected:"   # the key of rows that are no events, dealt over a few
REJECTED_KEYS = 64

OUTPUT_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),          # snapshot | final | counts
    T.StructField("block_id", T.StringType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("event_seconds", T.LongType()),
    # counts
    T.StructField("accepted", T.LongType()), T.StructField("duplicates", T.LongType()), T.StructField("late", T.LongType()),
    T.StructField("rejected", T.LongType()), *[T.StructField(f"unseen_{c}", T.LongType()) for c in ENCODED_COLUMNS],
    # snapshot: the batch prefix columns
    T.StructField("n_events", T.LongType()), T.StructField("elapsed_seconds", T.LongType()),
    T.StructField("distinct_event_types", T.LongType()), T.StructField("distinct_components", T.LongType()),
    T.StructField("warn_count", T.LongType()), T.StructField("error_count", T.LongType()),
    T.StructField("block_size_max", T.DoubleType()),
    T.StructField("first_component_encoded", T.IntegerType()), T.StructField("first_event_type_encoded", T.IntegerType()),
    T.StructField("dominant_component_encoded", T.IntegerType()), T.StructField("dominant_event_type_encoded", T.IntegerType()),
    T.StructField("type_counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("earlier", T.ArrayType(T.StringType())),   # the block's snapshots before this one, as texts
    # final: the batch feature columns
    T.StructField("hour_of_day", T.IntegerType()), T.StructField("is_error", T.IntegerType()),
    *[T.StructField(f"{c}_encoded", T.IntegerType()) for c in ENCODED_COLUMNS],
    T.StructField("block_size", T.DoubleType()), T.StructField("event_frequency", T.LongType()),
    T.StructField("first_seconds", T.LongType()), T.StructField("last_seconds", T.LongType()),
    T.StructField("reason", T.StringType()),
])
# What the operator itself emits: the fields above as one JSON text, so a row costs the
# Python side three values whatever its kind.
EMITTED_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "block_id", "payload")])

# What is held of a block, as JSON: its running totals, and two dictionaries that move into pages once they are large.
TOTALS = {"n": 0, "t_min": None, "t_max": None, "last": None, "warn": 0, "error": 0, "is_error": 0, "size": 0.0,
          "first_component": None, "first_event_type": None}
HELD_SCHEMA = T.MapType(T.StringType(), T.StructType([
    *[T.StructField(name, {"size": T.DoubleType(), "is_error": T.IntegerType(), "first_component": T.IntegerType(),
                           "first_event_type": T.IntegerType()}.get(name, T.LongType())) for name in TOTALS],
    T.StructField("counts", T.MapType(T.StringType(), T.ArrayType(T.LongType()))), T.StructField("counts_bits", T.IntegerType())]))
PAGE_KEY = T.StructType([T.StructField("block_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("page", T.LongType())])
BUCKETS = 4_096   # state is read and written by bucket of blocks: a call for each of them in a batch, not for each block
PAGE = 1_024      # entries of a block's dictionary that are held with its totals, and in a page beyond


class Paged:
    """A dictionary of one block: held with its totals while small, else dealt by hash over pages that are read when touched."""

    def __init__(self, pages, block: str, name: str, held: dict, most: int):
        self.pages, self.block, self.name, self.held, self.most = pages, block, name, held, most
        self.own, self.bits = held.get(name, {}), held.get(f"{name}_bits")
        self.size = len(self.own) if self.bits is None else held[f"{name}_size"]
        self.read, self.changed = {}, set()

    def _number(self, key: str) -> int:
        return zlib.crc32(key.encode()) & ((1 << self.bits) - 1)

    def _page(self, number: int) -> dict:
        if number not in self.read:
            found = self.pages.getValue((self.block, self.name, number))
            self.read[number] = {} if found is None else json.loads(found[0])
        return self.read[number]

    def get(self, key: str):
        return (self.own if self.bits is None else self._page(self._number(key))).get(key)

    def put(self, key: str, value) -> None:
        into = self.own
        if self.bits is not None:
            number = self._number(key)
            into = self._page(number)
            self.changed.add(number)
        self.size += key not in into
        into[key] = value

    def entries(self) -> dict:
        if self.bits is None:
            return self.own
        return {k: v for number in range(1 << self.bits) for k, v in self._page(number).items()}

    def store(self) -> None:
        if self.size > self.most << (self.bits or 0):   # four times the pages, so an entry moves a bounded number of times on average
            entries = self.entries()
            self.bits = max(1, (4 * self.size // self.most).bit_length())
            self.own, self.read, self.changed = {}, {number: {} for number in range(1 << self.bits)}, set(range(1 << self.bits))
            for key, value in entries.items():
                self.read[self._number(key)][key] = value
        for number in self.changed:
            self.pages.updateValue((self.block, self.name, number), (json.dumps(self.read[number]),))
        self.held[self.name] = self.own
        if self.bits is not None:
            self.held |= {f"{self.name}_bits": self.bits, f"{self.name}_size": self.size}

    def clear(self) -> None:
        for number in range(1 << self.bits if self.bits is not None else 0):
            self.pages.removeKey((self.block, self.name, number))


def _dominant(counts: dict, column: str) -> int:
    """The code with the highest count; among equals the smallest."""
    return min((-n, code) for key, (n, code) in counts.items() if key.startswith(column + ":"))[1]


class BlockProcessor(StatefulProcessor):
    """Folds the events of a bucket of blocks; see the module text. ``timeout`` None means only the end of the
    stream closes a block. A closed block keeps a tombstone (n = -1).
    ``free`` holds the code of each column's values that the vocabulary lacks."""

    def __init__(self, ks: list[int], timeout: int | None, dedupe: bool, tombstone: int | None = None, free: dict[str, int] | None = None,
                 page: int = PAGE):
        self.ks, self.timeout, self.dedupe, self.tombstone, self.free, self.page = sorted(ks), timeout, dedupe, tombstone, free or {}, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getValueState("blocks", "timer long, held string")
        self.pages = handle.getMapState("pages", PAGE_KEY, "page string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[str, list] = {}
        for row in rows:
            event = json.loads(row["event"])
            arrived.setdefault(event["block_id"], []).append(event)
        timer, held = self._load()
        changed = False
        for block, events in arrived.items():
            if block.startswith(REJECTED):
                yield _counts(block, rejected=len(events))
            elif held.get(block, TOTALS)["n"] < 0:
                yield _counts(block, late=len(events))
            else:
                state = held.setdefault(block, dict(TOTALS))
                before = state["n"]
                yield from self._take(block, state, events)
                changed |= state["n"] > before
        if changed:
            self._save(timer, held)

    def _take(self, block: str, state: dict, events: list) -> Iterator[Row]:
        """The events of one block, in the order of their arrival."""
        events.sort(key=lambda r: (r.get(ARRIVAL_CHUNK, ""), r[ARRIVAL_SEQ]))
        seen, counts = (Paged(self.pages, block, name, state, self.page) for name in ("seen", "counts"))
        duplicates, unseen = 0, dict.fromkeys(ENCODED_COLUMNS, 0)
        for event in events:
            if self.dedupe:
                if seen.get(event["row_key"]):
                    duplicates += 1
                    continue
                seen.put(event["row_key"], 1)
            self._fold(state, counts, event)
            for column, code in self.free.items():
                unseen[column] += event[f"{column}_encoded"] == code
            if state["n"] in self.ks:
                yield self._snapshot(block, state, counts.entries(), int(event["seconds"]))
        if len(events) > duplicates:
            seen.store()
            counts.store()
        yield _counts(block, accepted=len(events) - duplicates, duplicates=duplicates, **{f"unseen_{c}": n for c, n in unseen.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, held = self._load()
        # One timer stands for all blocks of the bucket whose time has come.
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for block, state in list(held.items()):
            expiry = self._expiry(state)
            if expiry is None or expiry > passed:
                continue
            if state["n"] < 0:
                del held[block]
                continue
            seen, counts = (Paged(self.pages, block, name, state, self.page) for name in ("seen", "counts"))
            entries = counts.entries()
            fields = final_fields(state, {c: _dominant(entries, c) for c in ENCODED_COLUMNS}, "timeout")
            seen.clear()
            counts.clear()
            held[block] = {"n": -1, "last": state["last"]}
            yield _row("final", block, **fields)
        self._save(None, held)   # the timer that was there has gone off

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int | None, dict]:
        stored = self.blocks.get()
        return (None, {}) if stored is None else (stored[0], json.loads(stored[1]))

    def _save(self, timer: int | None, held: dict) -> None:
        """Store the bucket, with a timer at the first time at which one of its blocks or tombstones ends."""
        due = min((t for t in map(self._expiry, held.values()) if t is not None), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self.blocks.update((due, json.dumps(held)))
        else:
            self.blocks.clear()

    def _expiry(self, state: dict) -> int | None:
        """The watermark runs timeout behind the newest event's real time, so it passes
        this point exactly when the newest event is more than timeout after ``last``."""
        if state["n"] < 0:
            return None if self.tombstone is None else (state["last"] + self.tombstone) * 1000
        return None if self.timeout is None else state["last"] * 1000 + 1

    def _fold(self, state: dict, counts: Paged, event: dict) -> None:
        seconds, level = int(event["seconds"]), event["log_level"].upper()
        if state["n"] == 0:
            state["first_component"], state["first_event_type"] = int(event["component_encoded"]), int(event["event_type_encoded"])
            state["t_min"] = state["t_max"] = seconds
        state["n"] += 1
        state["t_min"], state["t_max"], state["last"] = min(state["t_min"], seconds), max(state["t_max"], seconds), seconds
        state["warn"] += level in WARN_LEVELS
        state["error"] += level in ERROR_LEVELS
        state["is_error"] = max(state["is_error"], int(level == "ERROR"))
        state["size"] = max(state["size"], float(event["block_size"]))
        for column in ENCODED_COLUMNS:
            entry = f"{column}:{event[column]}"
            found = counts.get(entry)
            counts.put(entry, [1, int(event[f"{column}_encoded"])] if found is None else [found[0] + 1, found[1]])

    def _snapshot(self, block: str, state: dict, counts: dict, seconds: int) -> Row:
        types = {key.partition(":")[2]: n for key, (n, _) in counts.items() if key.startswith("event_type:")}
        earlier = state.get("snapshots", [])
        fields = dict(
            k=state["n"], event_seconds=seconds, n_events=state["n"],
            elapsed_seconds=state["t_max"] - state["t_min"], distinct_event_types=len(types),
            distinct_components=sum(key.startswith("component:") for key in counts),
            warn_count=state["warn"], error_count=state["error"], block_size_max=state["size"],
            first_component_encoded=state["first_component"], first_event_type_encoded=state["first_event_type"],
            dominant_component_encoded=_dominant(counts, "component"),
            dominant_event_type_encoded=_dominant(counts, "event_type"), type_counts=types)
        state["snapshots"] = [*earlier, json.dumps(fields)] if state["n"] < self.ks[-1] else []
        return _row("snapshot", block, **fields, earlier=earlier)


def final_fields(state: dict, dominant: dict[str, int], reason: str) -> dict:
    return {
        "hour_of_day": (state["t_min"] % 86_400) // 3_600, "is_error": state["is_error"],
        **{f"{c}_encoded": code for c, code in dominant.items()}, "block_size": state["size"], "event_frequency": state["n"],
        "first_seconds": state["t_min"], "last_seconds": state["t_max"], "event_seconds": state["last"], "reason": reason,
    }


def _row(kind: str, block: str, **fields) -> Row:
    return Row(kind=kind, block_id=block, payload=json.dumps(fields))


def _counts(block: str, **counts: int) -> Row:
    return _row("counts", block, **{"accepted": 0, "duplicates": 0, "late": 0, "rejected": 0, **counts})


def encoded_events(lines: DataFrame, source: str | Source, vocab: DataFrame, rejects: bool = False, **options) -> DataFrame:
    """Raw lines (batch or stream) to cleaned, coded events, with the batch rules.

    The vocabulary is only read: a value it lacks gets the next free code of its column. With
    ``rejects``, lines that give no event stay, under a few keys that ``block_stream`` only counts.
    """
    spec = get_source(source) if isinstance(source, str) else source
    parsed = parse(lines, spec, **options).observe(
        "input", F.count(F.lit(1)).alias("lines_received"),
        F.count_if(F.col("date").isNull() | F.col("block_id").isNull()).alias("lines_unparsed"))
    if not rejects:
        return code_events(drop_invalid(coerce(recognized(parsed))), vocab)
    named = coerce(parsed.withColumn("_belongs", F.col("date").isNotNull() & F.col("block_id").isNotNull()))
    event = F.col("_belongs") & valid()
    # What a rejected row holds is not looked at; it must only not be null.
    filler = {"datetime": F.lit("1970-01-01").cast("timestamp_ntz"), "block_id": F.concat(F.lit(REJECTED), F.pmod(F.col(ARRIVAL_SEQ), F.lit(REJECTED_KEYS))),
              **{c: F.lit(UNKNOWN) for c in ("log_level", *ENCODED_COLUMNS)}}
    kept = named.withColumn("_event", event).withColumns({c: F.when(F.col("_event"), F.col(c)).otherwise(v) for c, v in filler.items()})
    return code_events(kept.drop("_belongs", "_event"), vocab)


def free_codes(vocab: DataFrame) -> dict[str, int]:
    """The next free code of each column; one row per column comes to the driver."""
    found = {r["column"]: r["code"] + 1 for r in vocab.groupBy("column").agg(F.max("code").alias("code")).collect()}
    return {c: found.get(c, 0) for c in ENCODED_COLUMNS}


def code_events(events: DataFrame, vocab: DataFrame) -> DataFrame:
    content = ["date", "time", "pid", "log_level", "component", "event_type", "source_ip", "destination_ip", "block_size", "raw_message"]
    out = events.withColumns({
        "seconds": seconds_of(F.col("datetime")), "ts": F.col("datetime").cast("timestamp"),
        "row_key": F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in content]))})
    free = free_codes(vocab)
    for column in ENCODED_COLUMNS:
        codes = vocab.where(F.col("column") == column).select(F.col("value").alias(column), F.col("code").alias(f"{column}_encoded"))
        out = lookup(out, codes, [column]).withColumn(
            f"{column}_encoded", F.coalesce(f"{column}_encoded", F.lit(free[column])).cast("int"))
    out = out.observe("unseen", *[
        F.count_if(F.col(f"{c}_encoded") == free[c]).alias(f"unseen_{c}") for c in ENCODED_COLUMNS])
    kept = [c for c in (ARRIVAL_CHUNK, ARRIVAL_SEQ) if c in out.columns]
    return out.select(*kept, "block_id", "ts", "seconds", "log_level", "block_size", "row_key", *ENCODED_COLUMNS,
                      *[f"{c}_encoded" for c in ENCODED_COLUMNS])


def block_stream(events: DataFrame, source: str | Source, ks, tombstone_seconds: int | None = None,
                 timeout_seconds: int | None | str = "source", vocab: DataFrame | None = None, buckets: int = BUCKETS, page: int = PAGE) -> DataFrame:
    """Rows of OUTPUT_SCHEMA from a stream of coded events. With the vocabulary they were coded by,
    accepted events whose values it lacks are counted per column. ``buckets`` cannot change between
    runs on one checkpoint."""
    spec = get_source(source) if isinstance(source, str) else source
    timeout = spec.idle_timeout_seconds if timeout_seconds == "source" else timeout_seconds
    processor = BlockProcessor(list(ks), timeout, spec.dedupe, tombstone_seconds, free_codes(vocab) if vocab is not None else None, page)
    # An event is one JSON text: what Python reads costs by the value.
    ahead = events.select(
        F.pmod(F.xxhash64("block_id"), F.lit(buckets)).alias("bucket"), (F.col("ts") + F.make_dt_interval(secs=F.lit(AHEAD))).alias("ts"),
        F.to_json(F.struct(*[c for c in events.columns if c != "ts"])).alias("event"))
    emitted = ahead.withWatermark("ts", f"{(timeout or 0) + AHEAD} seconds").groupBy("bucket").transformWithState(
        processor, EMITTED_SCHEMA, "Append", "EventTime")
    inner = T.StructType([f for f in OUTPUT_SCHEMA if f.name not in ("kind", "block_id")])
    return emitted.withColumn("_p", F.from_json("payload", inner)).select("kind", "block_id", "_p.*")


def open_blocks(spark, checkpoint: str) -> DataFrame:
    """The blocks still in flight, read from the state of a stopped stream, as final rows."""
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

    held = state("blocks").select(F.explode(F.from_json("value.held", HELD_SCHEMA)).alias("block_id", "_held")).select("block_id", "_held.*").where("n > 0")

    def best(column: str):
        own = F.filter(F.map_entries("counts"), lambda e: e["key"].startswith(f"{column}:"))
        return F.array_min(F.transform(own, lambda e: F.struct((-e["value"][0]).alias("n"), e["value"][1].alias("code"))))

    pages = state("pages").where("user_map_key.name = 'counts'").select(
        F.col("user_map_key.block_id").alias("block_id"), F.from_json("user_map_value.page", "map<string, array<long>>").alias("counts"))
    paged = pages.select("block_id", *[best(c).alias(c) for c in ENCODED_COLUMNS]).groupBy("block_id").agg(
        *[F.min(c)["code"].alias(f"{c}_encoded") for c in ENCODED_COLUMNS])
    rows = held.where("counts_bits IS NULL").withColumns({f"{c}_encoded": best(c)["code"] for c in ENCODED_COLUMNS}).unionByName(
        held.where("counts_bits IS NOT NULL").join(paged, "block_id"))
    have = {
        "kind": F.lit("final"), "block_id": F.col("block_id"), "hour_of_day": F.floor(F.pmod("t_min", F.lit(86_400)) / 3_600),
        "is_error": F.col("is_error"), **{f"{c}_encoded": F.col(f"{c}_encoded") for c in ENCODED_COLUMNS}, "block_size": F.col("size"),
        "event_frequency": F.col("n"), "first_seconds": F.col("t_min"), "last_seconds": F.col("t_max"),
        "event_seconds": F.col("last"), "reason": F.lit("end_of_stream"),
    }
    return rows.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OUTPUT_SCHEMA])
