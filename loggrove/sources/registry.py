"""Log sources: how to read each one, what a block is, and how it is labeled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loggrove.functions.text import fenced
from loggrove.schema import STRUCTURED_COLUMNS
from loggrove.sources import apache, cloudtrail, django, hdfs, openstack
from loggrove.sources.lines import read_lines


@dataclass(frozen=True)
class Source:
    name: str
    title: str
    stages: Callable[[Column], list[dict[str, Column]]]  # helper columns, each computed once per line
    columns: Callable[..., dict[str, Column]]
    block_is: str
    label_kind: str
    protocol: str = "holdout"          # or "in_sample"
    dedupe: bool = True                # identical lines are one delivery
    idle_timeout_seconds: int | None = None
    payload: str = "value"             # the column the builder reads
    options: dict = field(default_factory=dict)


SOURCES: dict[str, Source] = {s.name: s for s in (
    Source("hdfs", "HDFS", hdfs.stages, hdfs.columns, "HDFS block named first", "published labels",
           protocol="in_sample", idle_timeout_seconds=43_663),
    Source("openstack", "OpenStack (nova)", openstack.stages, openstack.columns, "life of one instance", "label of the delivered file",
           idle_timeout_seconds=3_600),
    Source("apache", "Apache error log", apache.stages, apache.columns, "minute of the clock", "injected faults",
           dedupe=False, idle_timeout_seconds=120),
    Source("cloudtrail", "Audit trail", cloudtrail.stages, cloudtrail.columns, "hour of one identity", "weak rules",
           idle_timeout_seconds=3_600, payload="record"),
    Source("django", "Django", django.stages, django.columns, "all lines of a user", "synthetic", idle_timeout_seconds=None),
)}


def get_source(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; choose from {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def parse(frame: DataFrame, source: str | Source, **options) -> DataFrame:
    """Structured columns from a frame of raw lines (or audit records), batch or
    streaming; every other column (arrival order, source tag) is carried along."""
    spec = get_source(source) if isinstance(source, str) else source
    kept = [c for c in frame.columns if c != spec.payload]
    staged = frame
    for helpers in spec.stages(F.col(spec.payload)):
        staged = staged.withColumns(helpers)
    built = spec.columns(F.col(spec.payload), **{**spec.options, **options})
    return fenced(staged.select(*kept, *[built[c].alias(c) for c in STRUCTURED_COLUMNS]), STRUCTURED_COLUMNS)


def read_source(spark: SparkSession, source: str, paths: str | list[str], **options) -> DataFrame:
    """Scan and parse all files of one source."""
    spec = get_source(source)
    if spec.payload == "record":
        raw = cloudtrail.read_records(spark, paths)
    else:
        raw = read_lines(spark, paths)
    return parse(raw.withColumn("source", F.lit(spec.name)), spec, **options)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """One table over several sources (union all, matched by column name)."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
