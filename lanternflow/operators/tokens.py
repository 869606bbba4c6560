"""Turning events into tokens. Everything is fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators.scale import global_quantiles, global_rank, literal_table
from lanternflow.schema import FIRST_KNOWN_ID, PAD_ID, UNK_ID
from lanternflow.session import durable

# Event types of the port-class scheme.
DEFAULT_EVENT_TYPES = ["TCP_REGISTERED", "TCP_EPHEMERAL", "UDP_REGISTERED", "TCP_WELL_KNOWN",
                       "P0_WELL_KNOWN", "UDP_WELL_KNOWN", "UDP_EPHEMERAL"]
OTHER = "DST=OTHER"


def top_destinations(train: DataFrame, n: int) -> DataFrame:
    """The n most frequent destinations (ties: smallest name). Also used as allowlist."""
    return (train.groupBy(F.coalesce("dst_id", F.lit("")).alias("dst_id"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("dst_id")).limit(n))


def byte_edges(train: DataFrame, buckets: int, rows: int | None = None) -> list[float]:
    """Distinct quantiles of log bytes; a flat column gets one wide bin.

    Returns at most ``buckets + 1`` numbers.
    """
    logs = train.select(V.log_bytes(F.col("bytes")).alias("x"))
    edges = sorted(set(global_quantiles(logs, ["x"], [i / buckets for i in range(buckets + 1)], rows)["x"]))
    if len(edges) <= 2:
        low, high = logs.agg(F.min("x"), F.max("x")).first()
        return [low, high + 1e-6]
    return edges


def log_bin(x: Column, edges: list[float]) -> Column:
    """Index of the last edge not above the log size, kept inside the bins."""
    # The highest reached edge decides; a when-chain stays in generated code.
    out: Column = F.lit(0)
    for i in range(1, len(edges) - 1):
        out = F.when(x >= F.lit(edges[i]), F.lit(i)).otherwise(out)
    return out


@dataclass(frozen=True)
class Tokenizer:
    """Fitted token pieces.

    ``destinations`` holds at most top_n names in order; ``event_types`` is a table
    ``event_type, ei`` of the training event types and their rank by name.
    """

    destinations: list[str]
    event_types: DataFrame
    kinds: int
    edges: list[float]

    @property
    def bins(self) -> int:
        return max(1, len(self.edges) - 1)

    @property
    def buckets(self) -> int:
        return len(self.destinations) + 1

    @property
    def size(self) -> int:
        """Number of token ids, the two reserved ones included."""
        return self.kinds * self.buckets * self.bins + FIRST_KNOWN_ID


def build_tokenizer(destinations: list[str], event_types: DataFrame, edges: list[float]) -> Tokenizer:
    """Number the event types in their order. A null type is no type: its tokens are unknown."""
    kinds = event_types.filter(F.col("event_type").isNotNull()).distinct()
    ranked = durable(global_rank(kinds, ["event_type"], "ei").withColumn("ei", F.col("ei").cast("int")))
    return Tokenizer(sorted(destinations), ranked, ranked.count(), list(edges))


def fit_tokenizer(train: DataFrame, top_n: int, buckets: int, event_types: list[str] | None = None,
                  rows: int | None = None) -> Tokenizer:
    kinds = (train.sparkSession.createDataFrame([(t,) for t in event_types], "event_type string")
             if event_types else train.select("event_type").distinct())
    names = [r["dst_id"] for r in top_destinations(train, top_n).collect()]
    return build_tokenizer(names, kinds, byte_edges(train, buckets, rows))


def vocabulary(tok: Tokenizer) -> DataFrame:
    """Every event type x destination bucket x byte bin, numbered from 2."""
    dsts = F.array(*[F.struct(F.lit(f"DST={d}").alias("dst"), F.lit(i).alias("di"))
                     for i, d in enumerate([*tok.destinations, "OTHER"])])
    grid = (tok.event_types.select("event_type", "ei", F.explode(dsts).alias("d"))
            .select("event_type", "ei", "d.dst", "d.di", F.explode(F.sequence(F.lit(0), F.lit(tok.bins - 1))).alias("bi")))
    token_id = F.lit(FIRST_KNOWN_ID) + (F.col("ei") * tok.buckets + F.col("di")) * tok.bins + F.col("bi")
    return grid.select(token_id.cast("int").alias("token_id"), F.concat_ws(
        "|", "event_type", "dst", F.concat(F.lit("BYTES_Q"), F.col("bi").cast("string"))).alias("token_str"))


def tokenize(events: DataFrame, tok: Tokenizer) -> DataFrame:
    """Add ``dst_bucket, byte_bin, token_str, token_id``.

    The id follows from the three parts, so the grid itself is never joined. Kept
    destinations are bounded by top_n and broadcast; the event types are left to
    adaptive execution.
    """
    names = [F.struct(F.lit(d).alias("_dst"), F.lit(i).alias("di")) for i, d in enumerate(tok.destinations)]
    dsts = F.broadcast(literal_table(events.sparkSession, names or [F.struct(F.lit(None).cast("string").alias("_dst"),
                                                                             F.lit(0).alias("di"))]))
    kinds = tok.event_types.select(F.col("event_type").alias("_kind"), "ei")
    joined = (events.withColumns({"dst_id": F.coalesce("dst_id", F.lit("")), "_size": V.log_bytes(F.col("bytes"))})
              .join(dsts, F.col("dst_id") == F.col("_dst"), "left")
              .join(kinds, F.col("event_type") == F.col("_kind"), "left"))
    di = F.coalesce(F.col("di"), F.lit(tok.buckets - 1))
    bi = log_bin(F.col("_size"), tok.edges)
    known = F.lit(FIRST_KNOWN_ID) + (F.col("ei") * tok.buckets + di) * tok.bins + bi
    bucket = F.when(F.col("di").isNull(), OTHER).otherwise(F.concat(F.lit("DST="), "dst_id"))
    return joined.select(
        *[F.col(c) for c in events.columns], bucket.alias("dst_bucket"), bi.alias("byte_bin"),
        F.concat_ws("|", "event_type", bucket, F.concat(F.lit("BYTES_Q"), bi.cast("string"))).alias("token_str"),
        F.coalesce(known, F.lit(UNK_ID)).cast("int").alias("token_id"))


def token_name(token_id: Column, name: Column) -> Column:
    """Name of an id after a left join to the vocabulary."""
    return F.when(token_id == PAD_ID, "PAD").when(token_id == UNK_ID, "UNK").otherwise(
        F.coalesce(name, F.lit("UNK")))


def destination_of(token_str: Column) -> Column:
    """Destination bucket inside a token string, or an empty string."""
    part = F.get(F.filter(F.split(token_str, "\\|"), lambda p: p.startswith("DST=")), F.lit(0))
    return F.coalesce(F.regexp_replace(part, "DST=", ""), F.lit(""))


def unknown_token_rate(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.avg((F.col("token_id") == UNK_ID).cast("double")).alias("unk_rate"))
