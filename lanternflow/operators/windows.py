"""Sliding windows over each entity's ordered events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternflow.functions import values as V
from lanternflow.operators.scale import POS, HotKeys, over_sequences
from lanternflow.schema import TIME_ORDER


def _full_context(pos: str, seq_len: int, step: int) -> Column:
    return (F.col(pos) >= seq_len) & ((F.col(pos) - seq_len) % step == 0)


def sequences(tokens: DataFrame, seq_len: int, step: int = 1, keys: Sequence[str] = ("entity_id",),
              hot: HotKeys | None = None) -> DataFrame:
    """One row per full context: ``context`` holds the seq_len ids before ``token_id``.

    Entities with fewer than seq_len + 1 events give no rows.
    """
    def compute(part: DataFrame, w: WindowSpec, cols: list[str]) -> DataFrame:
        return part.withColumn("context", F.collect_list("token_id").over(w.rowsBetween(-seq_len, -1)))

    out = over_sequences(tokens, list(keys), TIME_ORDER, seq_len, compute, hot)
    return out.filter(_full_context(POS, seq_len, step)).withColumnRenamed(POS, "pos")


def window_features(tokens: DataFrame, seq_len: int, step: int = 1, keys: Sequence[str] = ("entity_id",),
                    hot: HotKeys | None = None) -> DataFrame:
    """The seven features of every full (context + target) window.

    All frames share one sort. ``t1`` and ``t2`` are the two tokens before the target.
    """
    width = seq_len + 1

    def compute(part: DataFrame, w: WindowSpec, cols: list[str]) -> DataFrame:
        frame = w.rowsBetween(-seq_len, 0)
        framed = part.withColumn("_x", V.log_bytes(F.col("bytes"))).select(
            "*",
            F.collect_list("token_id").over(frame).alias("_toks"), F.mode("token_id").over(frame).alias("_tok"),
            F.collect_list("dst_id").over(frame).alias("_dsts"), F.mode("dst_id").over(frame).alias("_dst"),
            F.avg("_x").over(frame).alias("bytes_mean"), F.stddev_pop("_x").over(frame).alias("bytes_std"),
            F.lag("token_id", 1).over(w).alias("t1"), F.lag("token_id", 2).over(w).alias("t2"))
        return framed.select(
            *part.columns, "t1", "t2",
            F.size(F.array_distinct("_toks")).cast("double").alias("tok_uniq"),
            (F.size(F.filter("_toks", lambda x: x == F.col("_tok"))) / F.lit(width)).alias("tok_top_share"),
            F.size(F.array_distinct("_dsts")).cast("double").alias("dst_uniq"),
            (F.size(F.filter("_dsts", lambda x: x == F.col("_dst"))) / F.lit(width)).alias("dst_top_share"),
            "bytes_mean", "bytes_std",
            (F.col("token_id") == F.col("t1")).cast("double").alias("repeat_last"))

    out = over_sequences(tokens, list(keys), TIME_ORDER, max(seq_len, 2), compute, hot)
    return out.filter(_full_context(POS, seq_len, step)).withColumnRenamed(POS, "pos")


MULTISCALE_METRICS = ["rate", "repetition", "peer_novelty", "port_diversity", "bytes_mean", "bytes_std", "fanout"]


def multiscale_names(widths: Sequence[int]) -> list[str]:
    return [f"w{w}_{m}" for w in widths for m in MULTISCALE_METRICS]


def _with_gaps(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Distance to the previous and next row with the same value, per sequence.

    The rows are already grouped by the keys, so this sorts but does not shuffle.
    """
    same = Window.partitionBy(*keys, value).orderBy(POS)
    return rows.select("*", (F.col(POS) - F.lag(POS).over(same)).alias(f"_{name}_back"),
                       (F.lead(POS).over(same) - F.col(POS)).alias(f"_{name}_ahead"))


def _with_distinct_counts(rows: DataFrame, w: WindowSpec, spans: dict[str, list[int]]) -> DataFrame:
    """Distinct values among the last n rows as ``_<name>_<n>``, at a cost that does not grow with n.

    A value is present from a row until n rows later, or longer if it recurs. So a
    stretch opens where the previous occurrence is n or more rows back and closes n rows
    after a row without a recurrence within n; the count is opened minus closed.
    """
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = [(name, n) for name, ns in spans.items() for n in ns]
    sums = rows.select("*", *[F.sum((F.coalesce(F.col(f"_{name}_{side}") >= n, F.lit(True))).cast("int")).over(upto)
                              .alias(f"_{name}_{side}_{n}") for name, n in pairs for side in ("back", "ahead")])
    return sums.select(*rows.columns, *[
        (F.col(f"_{name}_back_{n}") - F.coalesce(F.lag(f"_{name}_ahead_{n}", n).over(w), F.lit(0))).alias(f"_{name}_{n}")
        for name, n in pairs])


class Multiplicity:
    """How often the commonest of the last values occurs; a value that comes or goes costs the same at any width."""

    def __init__(self):
        self.count: dict = {}     # value -> its occurrences
        self.having: dict = {0: 0}  # number of occurrences -> values that have it
        self.top = 0

    def come(self, value) -> None:
        n = self.count[value] = self.count.get(value, 0) + 1
        self.having[n] = self.having.get(n, 0) + 1
        self.having[n - 1] = self.having.get(n - 1, 0) - 1
        self.top = max(self.top, n)

    def go(self, value) -> None:
        n = self.count.pop(value)
        if n > 1:
            self.count[value] = n - 1
        self.having[n] -= 1
        self.having[n - 1] += 1
        if n == self.top and not self.having[n]:
            self.top = n - 1


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, sum and squared deviations of two spans together."""
    (ca, sa, ma), (cb, sb, mb) = a, b
    n = ca + cb
    apart = np.where((ca > 0) & (cb > 0), sb / np.maximum(cb, 1) - sa / np.maximum(ca, 1), 0.0)
    return n, sa + sb, ma + mb + apart * apart * (ca * cb / np.maximum(n, 1))


def _sliding_moments(x: np.ndarray, known: np.ndarray, row: np.ndarray, widths: Sequence[int]) -> list[tuple]:
    """Mean and population deviation of the known values among the last n rows, and their number, for each width.

    ``row`` is the place in the sequence from 1; spans end where it begins. A span of 2k rows is merged from two of k, so the
    cost grows with the logarithm of the width; nothing is subtracted, so no digits are lost.
    """
    def back(span: tuple, k: int) -> tuple:
        """The span that ends k rows before; empty where the sequence begins later."""
        if not k:
            return span
        held = row[k:] > k
        return tuple(np.concatenate([np.zeros(min(k, len(c))), np.where(held, c[:-k], 0.0)]) for c in span)

    with np.errstate(invalid="ignore", over="ignore"):
        spans = {1: (known.astype(float), np.where(known, x, 0.0), np.where(known, x - x, 0.0))}
        k = 1
        while 2 * k <= max(widths):
            spans[2 * k] = _merged(spans[k], back(spans[k], k))
            k *= 2
        out = []
        for n in widths:
            found, done = None, 0
            for k in (k for k in spans if n & k):
                part = back(spans[k], done)
                found, done = part if found is None else _merged(found, part), done + k
            count, total, off = found
            many = np.maximum(count, 1)
            out.append((total / many, np.sqrt(off / many), count))
        return out


def _with_counted_spans(rows: DataFrame, value: str, size: str, row: str, widths: Sequence[int]) -> DataFrame:
    """Add ``_top_<n>``: occurrences of the commonest ``value`` among the last n rows (nulls take a place but don't
    count), and ``_mean_<n>`` and ``_std_<n>`` of ``size`` there.

    The partitions hold whole sequences in order and stream by; ``row`` counts a sequence from 1.
    Only the longest width of values is kept from batch to batch.
    """
    longest = max(widths)
    fields = [T.StructField(f"_top_{n}", T.IntegerType()) for n in widths]
    fields += [T.StructField(f"_{m}_{n}", T.DoubleType()) for n in widths for m in ("mean", "std")]

    def run(batches):
        past: list = []
        scales = [Multiplicity() for _ in widths]
        sizes, known, places = np.empty(0), np.empty(0, bool), np.empty(0, np.int64)
        for batch in batches:
            coded = batch.column(value).dictionary_encode()
            values = coded.dictionary.to_pylist()
            place = batch.column(row).to_numpy(zero_copy_only=False)
            tops: list[list[int]] = [[] for _ in widths]
            for starts, code in zip((place == 1).tolist(), coded.indices.to_pylist()):
                if starts:
                    past, scales = [], [Multiplicity() for _ in widths]
                new = None if code is None else values[code]
                for n, scale, top in zip(widths, scales, tops):
                    if len(past) >= n and past[-n] is not None:
                        scale.go(past[-n])
                    if new is not None:
                        scale.come(new)
                    top.append(scale.top)
                past.append(new)
            del past[:-longest]
            kept, column = len(sizes), batch.column(size)
            sizes = np.r_[sizes, column.fill_null(0.0).to_numpy(zero_copy_only=False)]
            known = np.r_[known, column.is_valid().to_numpy(zero_copy_only=False)]
            places = np.r_[places, place]
            spans = [pa.array(m[kept:], pa.float64(), mask=count[kept:] == 0)
                     for *moments, count in _sliding_moments(sizes, known, places, widths) for m in moments]
            sizes, known, places = (c[max(0, len(c) - longest):] for c in (sizes, known, places))
            yield pa.record_batch([*batch.columns, *[pa.array(t, pa.int32()) for t in tops], *spans],
                                  [*batch.schema.names, *[f.name for f in fields]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def multiscale_features(events: DataFrame, widths: Sequence[int] = (8, 32, 128),
                        keys: Sequence[str] = ("entity_id",), hot: HotKeys | None = None) -> DataFrame:
    """Causal behaviour features at several row-count horizons; short starts are allowed.

    Peers new to a horizon are those of the last 2n rows minus those of the n rows before it. The share of the commonest
    kind of event and the moments of the sizes are found while the sorted sequences stream by: no row holds a list of its
    window, and none reads it again.
    """

    def compute(part: DataFrame, w: WindowSpec, cols: list[str]) -> DataFrame:
        base = (part.withColumn("_x", V.log_bytes(F.col("bytes"))).withColumn("_at", F.unix_micros("timestamp"))
                .withColumn("_p", F.substring_index("event_type", ":", -1)))
        gaps = _with_gaps(_with_gaps(base, cols, "dst_id", "peer"), cols, "_p", "port")
        counted = _with_distinct_counts(gaps, w, {
            "peer": sorted({m for n in widths for m in (n, 2 * n)}), "port": sorted(set(widths))})
        frames = [F.row_number().over(w).alias("_row"),
                  F.first("_at").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_begin")]
        for n in widths:
            frames += [F.lag("_at", n - 1).over(w).alias(f"_back{n}"),
                       F.coalesce(F.lag(f"_peer_{n}", n).over(w), F.lit(0)).alias(f"_before{n}")]
        framed = counted.select("*", *frames)
        out = [*part.columns, "_row", "_x"]
        for n in widths:
            peers, rows = F.col(f"_peer_{n}"), F.least(F.col("_row"), F.lit(n))
            begin = F.when(F.col("_row") >= n, F.col(f"_back{n}")).otherwise(F.col("_begin"))
            seconds = F.greatest((F.col("_at") - begin) / F.lit(1e6), F.lit(1.0))
            out += [(rows / seconds).alias(f"w{n}_rate"),
                    ((F.col(f"_peer_{2 * n}") - F.col(f"_before{n}")) / F.greatest(peers, F.lit(1)))
                    .alias(f"w{n}_peer_novelty"),
                    F.col(f"_port_{n}").cast("double").alias(f"w{n}_port_diversity"), peers.cast("double").alias(f"w{n}_fanout")]
        # The window before has left the rows in this order, so neither a shuffle nor a sort is added.
        in_order = framed.select(*out).sortWithinPartitions(*cols, *TIME_ORDER)
        spans = _with_counted_spans(in_order, "event_type", "_x", "_row", list(widths))
        streamed = {f"w{n}_{m}": c for n in widths for m, c in (
            ("repetition", F.col(f"_top_{n}") / F.least(F.col("_row"), F.lit(n))),
            ("bytes_mean", F.col(f"_mean_{n}")), ("bytes_std", F.col(f"_std_{n}")))}
        return spans.select(*part.columns, *[streamed.get(c, F.col(c)).alias(c) for c in multiscale_names(widths)])

    return over_sequences(events, list(keys), TIME_ORDER, 2 * max(widths) - 1, compute, hot).drop(POS)


def last_token_accuracy(windows: DataFrame) -> DataFrame:
    """How often the next token simply repeats the last one."""
    return windows.agg(F.avg((F.col("t1") == F.col("token_id")).cast("double")).alias("last_token_accuracy"))
