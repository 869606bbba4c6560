"""Saving and loading a fitted detector with integrity checks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from lanternflow.operators.nextevent import NextEventModel
from lanternflow.operators.tokens import Tokenizer
from lanternflow.plans.detection import Detector
from lanternflow.sources.digests import table_digest

SCHEMA_VERSION = "1.2"
COUNTS = ["triples", "contexts", "pairs", "firsts", "tokens"]
TABLES = ["profiles", "event_types", *COUNTS]


class BundleError(RuntimeError):
    """The bundle is of another version or was changed after saving."""


def _payload_digest(config: dict) -> str:
    text = json.dumps({k: v for k, v in config.items() if k != "payload_sha256"}, sort_keys=True,
                      separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def _tables(d: Detector) -> dict[str, DataFrame]:
    return {"profiles": d.profiles, "event_types": d.tokenizer.event_types} | {n: getattr(d.model, n) for n in COUNTS}


def save_detector(d: Detector, path: str, dataset: dict | None = None) -> str:
    """Fitted tables as Parquet, settings as one JSON line; the digests tie them together."""
    spark = d.profiles.sparkSession
    for name, df in _tables(d).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    m = d.model
    config = {
        "schema_version": SCHEMA_VERSION, "model_version": d.version, "seq_len": d.seq_len,
        "features": d.features, "variant": d.variant, "threshold": d.threshold, "allowlist": sorted(d.allowlist),
        "allowlist_margin": d.allowlist_margin, "cooldown_seconds": d.cooldown_seconds,
        "destinations": d.tokenizer.destinations, "bytes_edges_log1p": d.tokenizer.edges,
        "event_type_count": d.tokenizer.kinds, "vocabulary_size": d.tokenizer.size,
        "global_nll": {"mean": d.nll_mean, "std": d.nll_std}, "global_median": d.medians, "global_scale": d.scales,
        "model": {"total": m.total, "vocab": m.vocab, "l2": m.l2, "l1": m.l1, "l0": m.l0, "a": m.a},
        "dataset": dataset or {},
        "table_digests": {n: table_digest(spark.read.parquet(f"{path}/{n}")) for n in TABLES},
    }
    config["payload_sha256"] = _payload_digest(config)
    line = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/config")
    return path


def load_detector(spark: SparkSession, path: str) -> Detector:
    """Rebuild the detector; any mismatch raises before a score is computed."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    if config.get("schema_version") != SCHEMA_VERSION:
        raise BundleError(f"unsupported bundle schema {config.get('schema_version')!r}")
    if config.get("payload_sha256") != _payload_digest(config):
        raise BundleError("the payload of the bundle was changed: its digest differs")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES}
    for name, df in tables.items():
        if table_digest(df) != config["table_digests"][name]:
            raise BundleError(f"bundle table {name} digest mismatch")
    tok = Tokenizer(config["destinations"], tables["event_types"], config["event_type_count"],
                    config["bytes_edges_log1p"])
    if not tok.size == config["vocabulary_size"] == config["model"]["vocab"]:
        raise BundleError("bundle and model vocabulary sizes differ")
    if config["seq_len"] < 2:
        raise BundleError("the next-event model needs two context tokens")
    return Detector(tok, NextEventModel(*[tables[n] for n in COUNTS], **config["model"]), tables["profiles"],
                    config["global_nll"]["mean"], config["global_nll"]["std"], config["global_median"],
                    config["global_scale"], config["seq_len"], config["features"], config["variant"],
                    config["threshold"], config["allowlist"], config["allowlist_margin"],
                    config["cooldown_seconds"], config["model_version"])
