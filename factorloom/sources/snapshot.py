"""Immutable dataset snapshots named by their content.

Every writer builds its artifacts (Parquet directories) in an attempt folder of its own below
``root/dataset_id``. What is published is a manifest, one small file added to a table of
manifests, as the last step: a snapshot without one does not exist yet. Writers never touch
each other's files and never replace any. Where two of one identity overlap, both may publish;
readers take the first manifest, and a writer that finds one returns it. This needs no rename
of folders, so it holds on object stores, and a lost executor only repeats tasks.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS, ContractError
from factorloom.operators.features import apply_robust_scaler, build_features, fit_robust_scaler
from factorloom.operators.indexes import inference_index, sample_index, sample_metadata
from factorloom.operators.labels import build_labels
from factorloom.operators.quality import (
    bundle_audit,
    feature_audit,
    index_audit,
    label_audit,
    looks_ahead,
    require_contract,
    split_counts,
)
from factorloom.operators.splits import SplitDates, assign_splits, session_dates
from factorloom.sources.tables import StandardTables

SCHEMA_VERSION = 3
MANIFESTS = "manifests"
ARTIFACTS = ("features", "labels", "sample_index", "sample_metadata", "inference_index")


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    split: SplitDates
    context_length: int = 512
    execution_lag: int = 1
    horizon: int = 5
    winsor_lower: float = 0.005
    winsor_upper: float = 0.995
    channels: tuple[str, ...] = CHANNELS


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def content_hash(frame: DataFrame) -> str:
    """Identity of a table's rows whatever their order or file layout.

    Two differently seeded sums of row hashes and the row count, combined map-side. The hash
    skips NULL, so every column brings its null flag along.
    """
    columns = [part for c in sorted(frame.columns) for part in (F.col(c), F.col(c).isNull())]

    def total(*salt):
        return F.sum(F.xxhash64(*salt, *columns).cast("decimal(38,0)")).cast("string")

    row = frame.agg(
        F.count(F.lit(1)).alias("rows"), total().alias("a"), total(F.lit("salt")).alias("b")
    ).first()
    schema = [f"{f.name}:{f.dataType.simpleString()}" for f in frame.schema.fields]
    return hashlib.sha256(canonical_json([sorted(schema), list(row)]).encode()).hexdigest()


def dataset_identity(tables: StandardTables, config: DatasetConfig) -> tuple[str, dict[str, Any]]:
    identity = {
        "schema_version": SCHEMA_VERSION,
        "config": asdict(config),
        "input_hashes": {name: content_hash(frame) for name, frame in tables.items()},
    }
    return hashlib.sha256(canonical_json(identity).encode()).hexdigest(), identity


def read_json(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """One small JSON document, or None where there is none."""
    try:
        rows = spark.read.option("wholetext", True).text(path).collect()
    except AnalysisException:
        return None
    return json.loads(rows[0][0]) if rows else None


def write_json(spark: SparkSession, document: dict[str, Any], path: str, mode: str = "error") -> None:
    text = spark.createDataFrame([(canonical_json(document),)], "value string")
    text.coalesce(1).write.mode(mode).text(path)


def index_report(index: DataFrame) -> DataFrame:
    """One row: repeated sample ids and rows that look ahead."""
    keyed = index.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_copies"), F.count_if(looks_ahead(index)).alias("_ahead")
    )
    return keyed.agg(
        F.count_if(F.col("_copies") > 1).alias("duplicates"),
        F.coalesce(F.sum("_ahead"), F.lit(0)).alias("ahead"),
    )


def _rows(frame: DataFrame) -> list[dict[str, Any]]:
    return [row.asDict(recursive=True) for row in frame.collect()]


def write_snapshot(
    tables: StandardTables,
    config: DatasetConfig,
    root: str,
    source_manifest: dict[str, Any] | None = None,
) -> tuple[str, dict[str, Any]]:
    """Build every artifact, or return the published snapshot of the same content.

    The bundle must keep its contracts; what was published has passed them.
    """
    spark = tables.bars.sparkSession
    dataset_id, identity = dataset_identity(tables, config)
    folder = f"{root.rstrip('/')}/{dataset_id}"
    published = published_manifest(spark, folder)
    if published is not None:
        return folder, published
    attempt = uuid.uuid4().hex
    for name, frame in tables.items():
        require_contract(frame, name)

    def store(frame: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{attempt}/{name}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    # The raw features are read by the scaler fit and by its application.
    raw = store(build_features(tables.bars, tables.universe), "features_raw")
    channels = list(config.channels)
    scaler = fit_robust_scaler(
        raw, config.split.train_end, channels, config.winsor_lower, config.winsor_upper
    )
    scaler = store(scaler, "scaler")
    features = store(apply_robust_scaler(raw, scaler, channels), "features")
    labels = build_labels(
        tables.bars, tables.universe, tables.delistings, config.execution_lag, config.horizon
    )
    labels = store(
        assign_splits(labels, session_dates(tables.universe), config.split), "labels"
    )
    samples = store(
        sample_index(features, labels, tables.universe, config.context_length), "sample_index"
    )
    live = store(
        inference_index(features, tables.universe, config.context_length), "inference_index"
    )
    store(sample_metadata(samples, tables.universe), "sample_metadata")
    for name, index in (("sample_index", samples), ("inference_index", live)):
        # One pass answers both questions.
        report = index_report(index).first()
        if report["duplicates"]:
            raise ContractError(f"{name} contains duplicate sample_id values")
        if report["ahead"]:
            raise ContractError(f"{name} contains look-ahead rows")

    # One-row reports and one row per channel, table or split.
    audit = {
        "sources": _rows(bundle_audit(tables)),
        "features": _rows(feature_audit(features)),
        "labels": _rows(label_audit(labels)),
        "splits": _rows(split_counts(samples)),
        "inference_index": _rows(index_audit(live)),
        "scaler": _rows(scaler),
    }
    write_json(spark, audit, f"{folder}/{attempt}/audit.json")
    if source_manifest is not None:
        write_json(spark, source_manifest, f"{folder}/{attempt}/source_manifest.json")
    manifest = {
        **json.loads(canonical_json(identity)),
        "dataset_id": dataset_id,
        "attempt": attempt,
        "created_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        "artifacts": [*ARTIFACTS, "scaler", "audit.json"],
        "has_source_manifest": source_manifest is not None,
    }
    if published_manifest(spark, folder) is None:
        write_json(spark, manifest, f"{folder}/{MANIFESTS}", mode="append")
    return folder, published_manifest(spark, folder)


def published_manifest(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    """The first manifest of a snapshot, or None where none is published."""
    try:
        rows = spark.read.text(f"{folder}/{MANIFESTS}").collect()
    except AnalysisException:
        return None
    found = [json.loads(row[0]) for row in rows]
    return min(found, key=lambda m: (m["created_at"], m["attempt"]), default=None)


def read_snapshot(
    spark: SparkSession, folder: str, *, minimum_schema: int = 2, names: tuple[str, ...] = ARTIFACTS
) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    """The manifest and the wanted artifacts of a published snapshot."""
    manifest = published_manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"no published snapshot in {folder}")
    if manifest.get("schema_version", 0) < minimum_schema:
        raise ContractError(f"snapshot schema {minimum_schema} or later is required")
    own = f"{folder}/{manifest['attempt']}"
    return manifest, {name: spark.read.parquet(f"{own}/{name}") for name in names}


def read_signal_snapshot(spark: SparkSession, folder: str):
    """Only the target-free artifacts that live signals may read."""
    return read_snapshot(
        spark, folder, minimum_schema=SCHEMA_VERSION, names=("features", "inference_index")
    )


def source_research_ready(spark: SparkSession, folder: str) -> bool | None:
    """The source manifest's readiness flag, NULL where unknown."""
    manifest = published_manifest(spark, folder) or {}
    payload = read_json(spark, f"{folder}/{manifest.get('attempt')}/source_manifest.json") or {}
    return (payload.get("selection") or {}).get("research_ready")
