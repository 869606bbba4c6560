"""Adapters from raw flow tables to the event schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.schema import EVENT_COLUMNS

# Spellings of the flow columns, preferred first.
COLUMN_ALIASES = {
    "Timestamp": ["Timestamp", "timestamp"],
    "Source IP": ["Source IP", "source_ip", "Src IP"],
    "Destination IP": ["Destination IP", "destination_ip", "Dst IP"],
    "Destination Port": ["Destination Port", "destination_port", "Dst Port"],
    "Protocol": ["Protocol", "protocol"],
    "Label": ["Label", "attack_label", "label"],
    "Total Length of Fwd Packets": ["Total Length of Fwd Packets", "total_length_of_fwd_packets"],
    "Total Length of Bwd Packets": ["Total Length of Bwd Packets", "total_length_of_bwd_packets"],
    "Subflow Fwd Bytes": ["Subflow Fwd Bytes", "subflow_fwd_bytes"],
    "Subflow Bwd Bytes": ["Subflow Bwd Bytes", "subflow_bwd_bytes"],
}
CLEAN_REQUIRED = ["timestamp", "entity_id", "event_type"]
FLOW_REQUIRED = ["Timestamp", "Source IP", "Destination IP", "Destination Port", "Protocol"]
UNSW_REQUIRED = ["Stime", "dstip", "srcip", "proto", "dsport", "sbytes", "dbytes"]
UNSW_EVENT_TYPES = ("proto_port", "cicids")


class MalformedRows(ValueError):
    """Raised in strict mode when required values cannot be parsed."""


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def resolve_column(columns: Sequence[str], name: str) -> str | None:
    """First known spelling of ``name`` that the table has."""
    return next((c for c in COLUMN_ALIASES.get(name, [name]) if c in columns), None)


def detect_format(columns: Sequence[str]) -> str:
    have = set(columns)
    if have.issuperset(CLEAN_REQUIRED):
        return "clean"
    if all(resolve_column(columns, c) for c in FLOW_REQUIRED):
        return "cicids"
    if have.issuperset(UNSW_REQUIRED):
        return "unsw"
    return "unknown"


def _require(columns: Sequence[str], needed: Sequence[str], what: str) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")


def drop_or_fail(df: DataFrame, bad: Column, drop_malformed: bool) -> DataFrame:
    """Malformed-row policy: drop them, or fail and say how many there are."""
    if not drop_malformed:
        n = df.filter(bad).count()
        if n:
            raise MalformedRows(f"{n} rows lack a required value or hold one that cannot be read")
    return df.filter(~bad)


def adapt_clean(df: DataFrame, drop_malformed: bool = True) -> DataFrame:
    df = trim_columns(df)
    _require(df.columns, CLEAN_REQUIRED, "clean event table")
    label = next((c for c in ("Label", "label") if c in df.columns), None)
    optional = {
        "dst_id": F.coalesce(F.col("dst_id").cast("string"), F.lit("")) if "dst_id" in df.columns else F.lit(""),
        "bytes": F.coalesce(V.to_number(F.col("bytes")), F.lit(0.0)) if "bytes" in df.columns else F.lit(0.0),
        "label": F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit(""),
    }
    extra = [c for c in ("event_row_id",) if c in df.columns]
    out = df.select(V.parse_utc(F.col("timestamp")).alias("timestamp"),
                    F.col("entity_id").cast("string").alias("entity_id"),
                    F.col("event_type").cast("string").alias("event_type"),
                    *[c.alias(n) for n, c in optional.items()], *extra)
    bad = F.col("timestamp").isNull() | F.col("entity_id").isNull() | F.col("event_type").isNull()
    return drop_or_fail(out, bad, drop_malformed)


def flow_bytes(columns: Sequence[str]) -> Column:
    """Forward plus backward bytes, from the totals or else the subflow pair."""
    for pair in (("Total Length of Fwd Packets", "Total Length of Bwd Packets"),
                 ("Subflow Fwd Bytes", "Subflow Bwd Bytes")):
        fwd, bwd = (resolve_column(columns, c) for c in pair)
        if fwd and bwd:
            return F.coalesce(V.to_number(F.col(f"`{fwd}`")) + V.to_number(F.col(f"`{bwd}`")), F.lit(0.0))
    return F.lit(0.0)


def adapt_cicids(df: DataFrame, entity_side: str = "dst", drop_malformed: bool = True) -> DataFrame:
    """CICIDS-style flows. ``entity_side`` picks whose behaviour is profiled."""
    if entity_side not in ("dst", "src"):
        raise ValueError("entity_side must be 'dst' or 'src'")
    df = trim_columns(df)
    found = {c: resolve_column(df.columns, c) for c in FLOW_REQUIRED + ["Label"]}
    missing = [c for c in FLOW_REQUIRED if found[c] is None]
    if missing:
        raise ValueError(f"flow table lacks required columns: {missing}")

    def at(name: str) -> Column:
        return F.col(f"`{found[name]}`")

    ends = {"dst": F.trim(at("Destination IP").cast("string")), "src": F.trim(at("Source IP").cast("string"))}
    label = F.trim(F.coalesce(at("Label").cast("string"), F.lit(""))) if found["Label"] else F.lit("")
    out = df.select(
        V.parse_day_first(at("Timestamp")).alias("timestamp"),
        ends[entity_side].alias("entity_id"),
        V.port_class(at("Protocol"), at("Destination Port")).alias("event_type"),
        ends["src" if entity_side == "dst" else "dst"].alias("dst_id"),
        flow_bytes(df.columns).alias("bytes"), label.alias("label"),
        *[c for c in ("event_row_id",) if c in df.columns])
    return drop_or_fail(out, F.col("timestamp").isNull() | F.col("entity_id").isNull(), drop_malformed)


def adapt_unsw(df: DataFrame, drop_malformed: bool = True, event_types: str = "proto_port",
               unnamed_attack: bool = False) -> DataFrame:
    """UNSW-style flows with epoch seconds."""
    if event_types not in UNSW_EVENT_TYPES:
        raise ValueError(f"event_types must be one of {UNSW_EVENT_TYPES}")
    df = trim_columns(df)
    _require(df.columns, UNSW_REQUIRED, "UNSW flow table")
    flag = next((c for c in ("label", "Label") if c in df.columns), None)
    proto = F.lower(F.trim(F.col("proto").cast("string")))
    port = F.trim(F.col("dsport").cast("string"))
    kind = (V.port_class(F.coalesce(proto, F.lit("")), F.coalesce(port, F.lit("")))
            if event_types == "cicids" else F.concat(proto, F.lit(":"), port))
    total = V.to_number(F.col("sbytes")) + V.to_number(F.col("dbytes"))
    out = df.select(
        F.timestamp_seconds(V.to_number(F.col("Stime"))).alias("timestamp"),
        F.trim(F.col("dstip").cast("string")).alias("entity_id"), kind.alias("event_type"),
        F.trim(F.col("srcip").cast("string")).alias("dst_id"), F.greatest(total, F.lit(0.0)).alias("_bytes"),
        total.alias("_total"),
        V.normalize_label(F.col("attack_cat") if "attack_cat" in df.columns else F.lit(""),
                          F.col(flag) if flag else F.lit(None).cast("string"), unnamed_attack).alias("label"),
        proto.alias("_proto"), port.alias("_port"), *[c for c in ("event_row_id",) if c in df.columns])
    bad = F.lit(False)
    for c in ("timestamp", "entity_id", "dst_id", "_proto", "_port", "_total"):
        bad = bad | F.col(c).isNull()
    kept = drop_or_fail(out, bad, drop_malformed).withColumnRenamed("_bytes", "bytes")
    return kept.select(*EVENT_COLUMNS, *[c for c in ("event_row_id",) if c in df.columns])


def adapt(df: DataFrame, fmt: str = "auto", **options) -> DataFrame:
    """Trim the column names, detect the layout and run its adapter."""
    df = trim_columns(df)
    fmt = detect_format(df.columns) if fmt == "auto" else fmt
    known = {"clean": adapt_clean, "cicids": adapt_cicids, "unsw": adapt_unsw}
    if fmt not in known:
        raise ValueError(f"cannot tell the layout from columns {df.columns}")
    return known[fmt](df, **options)


def keep_entities(df: DataFrame, at_least: int) -> DataFrame:
    """Entities with enough events. Counts combine map-side before the semi join."""
    enough = df.groupBy("entity_id").count().filter(F.col("count") >= at_least).select("entity_id")
    return df.join(enough, "entity_id", "left_semi")


def keep_label(df: DataFrame, label: str | None) -> DataFrame:
    return df.filter(F.col("label") == label) if label else df
