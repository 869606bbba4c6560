"""Windows, ranks, running sums and exact quantiles that survive hot keys.

Spark puts all rows of a window partition or of an exact percentile into one
task. These helpers keep that plan while every key is small, and split the keys
that are not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lanternflow.session import durable, max_group_rows

POS = "_pos"
CHUNK = "_chunk"
INDEX = "_index"
BLOCK = "_block"
# Up to this many hot keys are broadcast.
HOT_KEYS = 100_000


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than one task should hold (``table`` is None if there are none)."""

    columns: tuple[str, ...]
    rows: int            # rows of the hot keys
    limit: int
    table: DataFrame | None
    total: int = 0       # rows of all keys

    @property
    def most(self) -> int:
        """Bound on the number of hot keys."""
        return self.rows // self.limit

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if self.table is None:
            return df, None
        keys, on = few(self.table, self.most), list(self.columns)
        return df.join(keys, on, "left_anti"), df.join(keys, on, "left_semi")


def few(small: DataFrame, rows: int) -> DataFrame:
    """The small side of a join: broadcast if it has at most about ``HOT_KEYS`` rows, else joined by a shuffle."""
    return F.broadcast(small) if rows <= HOT_KEYS else small.hint("merge")


def hot_keys(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> HotKeys:
    """Count rows per key (combined map-side) and list the keys above the limit."""
    limit = limit or max_group_rows(df.sparkSession)
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    top, rows = counts.agg(F.max("_n"), F.sum("_n")).first()
    if (top or 0) <= limit:
        return HotKeys(tuple(columns), 0, limit, None, rows or 0)
    table = durable(counts.filter(F.col("_n") > limit))
    hot_rows = table.agg(F.sum("_n")).first()[0]
    return HotKeys(tuple(columns), hot_rows, limit, table.select(*columns), rows)


def range_chunks(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition by the full sort key, sort, and store rows with chunk and index.

    Spark samples the key, so chunks are even even if one key holds most rows; without a
    number, adaptive execution picks how many (neighbouring ranges are merged). The
    written table pins both numbers; the index needs no window because it is counted
    while each sorted chunk streams by.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    in_order = ranged.sortWithinPartitions(*order)
    # The lower 33 bits of the id count the rows of a partition.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return durable(in_order.select("*", F.spark_partition_id().alias(CHUNK), row.alias(INDEX)))


def _chunk_offsets(chunked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and chunk: rows in earlier chunks minus the index of its first row."""
    totals = chunked.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min(INDEX).alias("_first"))
    before = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, CHUNK, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))


def _ranked(chunked: DataFrame, by: Sequence[str], name: str, groups: int = 0) -> DataFrame:
    # One offset row per chunk and group that touches it, so no more than chunks and groups together.
    joined = chunked.join(few(_chunk_offsets(chunked, by), groups), [*by, CHUNK])
    return joined.withColumn(name, F.col("_shift") + F.col(INDEX)).drop(CHUNK, INDEX, "_shift")


def global_rank(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Dense 0-based row number in a total order: one range shuffle, no window over the rows."""
    return _ranked(range_chunks(df, order, partitions), [], name)


def over_sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int,
                   compute: Callable[[DataFrame, WindowSpec, list[str]], DataFrame],
                   hot: HotKeys | None = None) -> DataFrame:
    """Apply row frames over each key's ordered sequence.

    ``compute(part, w, keys)`` adds columns that depend on at most ``halo`` rows before;
    ``w`` orders each sequence, ``keys`` are its partition columns and ``_pos`` holds the
    0-based position. Small keys use
    one sort per key. Hot keys are cut into blocks of consecutive positions, and each
    block gets the last ``halo`` rows of the block before it.
    """
    hot = hot or hot_keys(df, keys)
    cold_rows, hot_rows = hot.split(df)
    w = Window.partitionBy(*keys).orderBy(*order)
    cold = compute(cold_rows.withColumn(POS, (F.row_number().over(w) - 1).cast("long")), w, list(keys))
    if hot_rows is None:
        return cold
    size = max(hot.limit, halo)
    placed = _ranked(range_chunks(hot_rows, [*keys, *order], max(2, math.ceil(hot.rows / hot.limit))), keys, POS, hot.most)
    own = F.floor(F.col(POS) / size)
    is_tail = F.col(POS) % size >= size - halo
    copies = placed.withColumn("_own", own).withColumn(
        BLOCK, F.explode(F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))))
    blocks = compute(copies, Window.partitionBy(*keys, BLOCK).orderBy(*order), [*keys, BLOCK])
    return cold.unionByName(blocks.filter(F.col(BLOCK) == F.col("_own")).drop("_own", BLOCK))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos",
              hot: HotKeys | None = None) -> DataFrame:
    """0-based position of every row inside its key."""
    return over_sequences(df, keys, order, 0, lambda part, w, cols: part, hot).withColumnRenamed(POS, name)


# Exact order statistics -------------------------------------------------------------

_GRID = 200
_SKETCH_ACCURACY = 4000
Ranks = Callable[[Column], tuple[Column, Column]]


def _attach(df: DataFrame, small: DataFrame, by: Sequence[str], groups: int = 0) -> DataFrame:
    """Add the columns of a per-group table with at most ``groups`` rows; without groups its one row is inlined."""
    if by:
        return df.join(few(small, groups), list(by))
    row = small.first()
    return df.select("*", *[_literal(row[f.name], f.dataType).alias(f.name) for f in small.schema.fields
                            if f.name not in df.columns])


def literal_table(spark: SparkSession, cells: Sequence[Column]) -> DataFrame:
    """A table of a few literal structs, built in the JVM."""
    return spark.range(1).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _literal(value, kind) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def _brackets(df: DataFrame, values: Sequence[str], ranks: Ranks, by: Sequence[str],
              limit: int, rows: int | None = None, groups: int = 0) -> DataFrame | None:
    """Narrow value ranges that contain the wanted ranks, or None if no group is large.

    Every round is one aggregation pass. A sketch of the values inside the current
    range picks the next, narrower range; the counts are exact.
    """
    if rows is not None and rows <= limit:
        return None
    counts = df.groupBy(*by).agg(*[F.count(v).alias(f"n_{v}") for v in values])
    largest = counts.agg(*[F.max(f"n_{v}").alias(v) for v in values]).first()
    if max((x or 0) for x in largest) <= limit:
        return None
    counts = durable(counts)
    types = dict(df.select(*values).dtypes)
    bounds = counts
    for v in values:
        bounds = (bounds.withColumn(f"lo_{v}", F.lit(None).cast(types[v]))
                  .withColumn(f"hi_{v}", F.lit(None).cast(types[v])))
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    measured = None
    before = None
    while True:
        aggs = []
        for v in values:
            x, lo, hi = F.col(v), F.col(f"lo_{v}"), F.col(f"hi_{v}")
            under = F.coalesce(x < lo, F.lit(False))
            inside = x.isNotNull() & F.coalesce(x >= lo, F.lit(True)) & F.coalesce(x <= hi, F.lit(True))
            aggs += [F.count_if(under).alias(f"below_{v}"), F.count_if(inside).alias(f"in_{v}"),
                     F.percentile_approx(F.when(inside, x), grid, _SKETCH_ACCURACY).alias(f"g_{v}")]
        # A row of bounds also holds the grid of every column, so fewer of them are broadcast.
        wide = groups * max(1, _GRID * len(values) // 10)
        found = _attach(df, bounds, by, wide).groupBy(*by).agg(*aggs)
        measured = durable(_attach(found, bounds, by, wide))
        # A range of a single value needs no further narrowing: it aggregates to one row.
        worst = measured.agg(*[F.max(F.when(F.coalesce(F.col(f"lo_{v}") != F.col(f"hi_{v}"), F.lit(True)),
                                            F.col(f"in_{v}"))).alias(v) for v in values]).first()
        if max((x or 0) for x in worst) <= limit:
            break
        if tuple(worst) == before:
            raise RuntimeError(f"value ranges of {list(values)} stay above {limit} rows: {tuple(worst)}")
        before = tuple(worst)
        cols = [*by]
        for v in values:
            below, inner = F.col(f"below_{v}"), F.greatest(F.col(f"in_{v}"), F.lit(1))
            k0, k1 = ranks(F.col(f"n_{v}"))
            i0 = F.greatest(F.floor((k0 - below) / inner * _GRID) - 1, F.lit(0))
            i1 = F.least(F.ceil((k1 - below) / inner * _GRID) + 1, F.lit(_GRID))
            cols += [F.col(f"n_{v}"), F.get(f"g_{v}", i0.cast("int")).alias(f"lo_{v}"),
                     F.get(f"g_{v}", i1.cast("int")).alias(f"hi_{v}")]
        bounds = measured.select(*cols)
    return measured


def select_ranks(df: DataFrame, values: Sequence[str], ranks: Ranks, by: Sequence[str] = (),
                 limit: int | None = None, rows: int | None = None) -> DataFrame:
    """Exact values at two 0-based ranks of each value column, per group.

    Result: ``by..., feature, n, v0, v1, below, same`` where ``below`` counts values under
    ``v0`` and ``same`` the ones equal to it. ``ranks(n)`` gives the two ranks, which should
    lie close together. Nulls are ignored; ``rows`` saves a count if the caller knows it.
    Groups that fit one task are ranked directly. For the others (few, by their size) the
    values are first narrowed to brackets around the ranks.
    """
    limit = limit or max_group_rows(df.sparkSession)
    base = df.select(*by, *values)
    if not by:
        large = None if rows is not None and rows <= limit else _large_ranks(base, [(v, v, ranks) for v in values], limit)
        return _rank_cells(base, values, ranks, by, False) if large is None else large
    found = hot_keys(base, by, limit)
    cold, hot = found.split(base)
    direct = _rank_cells(cold, values, ranks, by, False)
    if hot is None:
        return direct
    brackets = _brackets(hot, values, ranks, by, limit, groups=found.most)
    inside = hot if brackets is None else _attach(hot, brackets, by, found.most * max(1, _GRID * len(values) // 10))
    return direct.unionByName(_rank_cells(inside, values, ranks, by, brackets is not None))


# The rank error of a sketch is about 1 / accuracy of the rows; brackets allow for somewhat more.
_FINE_ACCURACY, _SLACK = 10_000, 2.5e-4


@dataclass
class _Bracket:
    """Values ``lo`` to ``hi`` (none: open) of a column, with ``below`` rows under and ``inside`` rows in them."""

    feature: str
    column: str
    n: int
    k0: int
    k1: int
    inside: int
    lo: object = None
    hi: object = None
    below: int = 0
    slack: float = _SLACK
    low_open: bool = False   # the sketch finds no end on that side, as beyond NaN
    high_open: bool = False

    def holds(self) -> Column:
        x = F.col(self.column)
        low = F.lit(True) if self.lo is None else x >= F.lit(self.lo)
        return x.isNotNull() & low & (F.lit(True) if self.hi is None else x <= F.lit(self.hi))

    @property
    def single(self) -> bool:
        return self.lo is not None and self.hi is not None and (
            self.lo == self.hi or (self.lo != self.lo and self.hi != self.hi))

    def shares(self) -> list[float]:
        """Shares of the inside rows that lie around the two ranks."""
        low, high = ((k - self.below) / self.inside for k in (self.k0, self.k1 + 1))
        return [max(low - self.slack, 0.0), min(high + self.slack, 1.0)]


def _large_ranks(base: DataFrame, targets: Sequence[tuple[str, str, Ranks]], limit: int) -> DataFrame | None:
    """``select_ranks`` of whole columns, for all (feature, column, ranks) at once; None if no column is large.

    One pass counts, one sketches a bracket around each pair of ranks, one counts the rows under and in the
    brackets, and one ranks what lies in those that hold more than one value. All counts are exact: a bracket
    that misses its ranks is widened, one that is still too large is narrowed again.
    """
    spark, types = base.sparkSession, dict(base.dtypes)
    known = base.agg(*[F.array(F.count(c), *[k.cast("long") for k in ranks(F.count(c))]).alias(f"k{i}")
                       for i, (_, c, ranks) in enumerate(targets)]).first()
    if max(n for n, _, _ in known) <= limit:
        return None
    found = [_Bracket(f, c, n, k0, k1, n) for (f, c, _), (n, k0, k1) in zip(targets, known) if 0 <= k0 < n]
    wide = list(found)
    while wide:
        sketches = base.agg(*[F.percentile_approx(
            F.when(b.holds(), F.col(b.column)), b.shares(), _FINE_ACCURACY).alias(f"g{i}") for i, b in enumerate(wide)]).first()
        tried = [replace(b, lo=b.lo if b.low_open else g[0], hi=b.hi if b.high_open else g[1]) for b, g in zip(wide, sketches)]
        counts = base.agg(*[F.array(
            F.lit(0).cast("long") if b.lo is None else F.count_if(F.col(b.column) < F.lit(b.lo)), F.count_if(b.holds())).alias(f"c{i}")
            for i, b in enumerate(tried)]).first()
        rest = []
        for old, new, (below, inside) in zip(wide, tried, counts):
            low, high = below > new.k0, min(new.k1, new.n - 1) >= below + inside
            if low or high:
                rest.append(old)
                if old.slack > _SLACK:
                    old.low_open, old.high_open = old.low_open or low, old.high_open or high
                old.slack = min(old.slack * 8, 1.0)
            else:
                new.below, new.inside, new.slack = below, inside, _SLACK
                found[next(i for i, b in enumerate(found) if b is old)] = new
                # What can't be narrowed are ties at the ends, which aggregate to a row each.
                if limit < inside < old.inside and not _one_value(new):
                    rest.append(new)
        wide = rest
    cells = [F.struct(F.lit(b.feature).alias("feature"), F.lit(b.n).cast("long").alias("n"),
                      *[_literal(b.lo, types[b.column]).alias(v) for v in ("v0", "v1")],
                      F.lit(b.below).cast("long").alias("below"), F.lit(b.inside).cast("long").alias("same"))
             for b in found if _one_value(b)]
    several = [b for b in found if not _one_value(b)]
    if not several:
        return literal_table(spark, cells) if cells else _rank_cells(base.limit(0), [c for _, c, _ in targets], targets[0][2], [], False)
    held = F.filter(F.array(*[F.struct(F.lit(b.feature).alias("feature"), F.when(b.holds(), F.col(b.column)).alias("value"),
                                       *[F.lit(x).cast("long").alias(c) for c, x in (
                                           ("n", b.n), ("base", b.below), ("k0", b.k0), ("k1", b.k1))]) for b in several]),
                    lambda c: c["value"].isNotNull())
    ranked = _running_counts(base.select(F.explode(held).alias("c")).select("c.*"), ["feature"], ["n", "base", "k0", "k1"])
    picked = _at_ranks(ranked, ["feature"], F.col("k0"), F.col("k1"))
    return picked.unionByName(literal_table(spark, cells)) if cells else picked


def _one_value(b: _Bracket) -> bool:
    return b.single and b.k1 < b.below + b.inside


def _running_counts(flat: DataFrame, group: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Rows per distinct value, and as ``upto`` those of it and all smaller ones, with ``base`` added."""
    counted = flat.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("cnt"), *[F.max(c).alias(c) for c in carried])
    upto = F.sum("cnt").over(Window.partitionBy(*group).orderBy("value")
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.coalesce(F.col("n"), F.sum("cnt").over(Window.partitionBy(*group)))
    return counted.select(*group, "value", "cnt", *[c for c in carried if c not in ("n", "base")], total.alias("n"),
                          (F.col("base") + upto).alias("upto"))


def _at_ranks(ranked: DataFrame, group: Sequence[str], k0: Column, k1: Column) -> DataFrame:
    return ranked.groupBy(*group).agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("upto") > k0, F.col("value"))).alias("v0"),
        F.min(F.when(F.col("upto") > k1, F.col("value"))).alias("v1"),
        F.min(F.when(F.col("upto") > k0, F.col("upto") - F.col("cnt"))).alias("below"),
        F.min_by("cnt", F.when(F.col("upto") > k0, F.col("upto"))).alias("same"))


def _rank_cells(base: DataFrame, values: Sequence[str], ranks: Ranks, by: Sequence[str], bracketed: bool) -> DataFrame:
    def cell(v: str) -> Column:
        x = F.col(v)
        known = F.col(f"n_{v}") if bracketed else F.lit(None).cast("long")
        below = F.col(f"below_{v}") if bracketed else F.lit(0).cast("long")
        if bracketed:
            lo, hi = F.col(f"lo_{v}"), F.col(f"hi_{v}")
            x = F.when(F.coalesce(x >= lo, F.lit(True)) & F.coalesce(x <= hi, F.lit(True)), x)
        return F.struct(F.lit(v).alias("feature"), x.alias("value"), known.alias("n"), below.alias("base"))

    cells = F.filter(F.array(*[cell(v) for v in values]), lambda c: c["value"].isNotNull())
    flat = base.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    group = [*by, "feature"]
    return _at_ranks(_running_counts(flat, group, ["n", "base"]), group, *ranks(F.col("n")))


def _quantile_ranks(prob: float) -> Ranks:
    def ranks(n: Column) -> tuple[Column, Column]:
        at = (n - 1) * F.lit(float(prob))
        return F.floor(at), F.ceil(at)

    return ranks


def exact_quantile(df: DataFrame, values: Sequence[str], prob: float, method: str = "linear",
                   by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Exact quantile per group and value column: ``by..., feature, n, quantile``.

    ``linear`` interpolates between neighbours as Spark's ``percentile`` and ``median`` do, to the last bit, so
    that no result depends on which of them a group's size calls for; ``higher`` takes the upper one.
    """
    if method not in ("linear", "higher"):
        raise ValueError(f"unknown method {method!r}")

    picked = select_ranks(df, values, _quantile_ranks(prob), by, limit)
    at = (F.col("n") - 1) * F.lit(float(prob))
    between = (F.ceil(at) - at) * F.col("v0") + (at - F.floor(at)) * F.col("v1")
    value = F.col("v1") if method == "higher" else F.when(F.col("v0") == F.col("v1"), F.col("v0").cast("double")).otherwise(between)
    return picked.select(*by, "feature", "n", value.alias("quantile"))


def global_quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float],
                     rows: int | None = None) -> dict[str, list[float]]:
    """Exact linear quantiles of whole columns, as driver scalars.

    One ``percentile`` aggregate while the columns fit one task, else a bracketed search for all of them
    at once, over the stored columns. ``rows`` saves the count if the caller knows it.
    """
    rows, limit = df.count() if rows is None else rows, max_group_rows(df.sparkSession)
    if rows <= limit:
        at = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(v, at).alias(v) for v in values]).first()
        return {v: list(row[v] or []) for v in values}
    stored = durable(df.select(*values))
    targets = [(f"{i} {v}", v, _quantile_ranks(p)) for v in values for i, p in enumerate(probs)]
    picked = _large_ranks(stored, targets, limit)
    if picked is None:  # nulls take no part, so the columns may be small after all
        return global_quantiles(stored, values, probs, limit)
    at_ranks = {r["feature"]: r for r in picked.collect()}
    found: dict[str, list[float]] = {v: [] for v in values}
    for v in values:
        for i, p in enumerate(probs):
            r = at_ranks.get(f"{i} {v}")
            if r is not None:
                at = (r["n"] - 1) * float(p)
                low, high = float(r["v0"]), float(r["v1"])
                found[v].append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return found


def key_at_rank(df: DataFrame, order: Sequence[str], rank: int, rows: int | None = None) -> tuple | None:
    """Sort key of the row at a 0-based rank (None past the end); needs no global sort.

    Later columns are searched only among rows that tie on the earlier ones, and the key
    is cut short where nothing ties.
    """
    found: list = []
    rest, left = df.select(*order), rank
    for c in order:
        k = F.lit(int(left)).cast("long")
        row = select_ranks(rest, [c], lambda n: (k, k), rows=rows).first()
        if row is None or row["v0"] is None:
            return None
        found.append(row["v0"])
        if row["same"] == 1:
            break
        left, rows = left - row["below"], row["same"]
        rest = rest.filter(F.col(c) == F.lit(row["v0"]))
    return tuple(found)


def before_key(order: Sequence[str], key: tuple | None) -> Column:
    """Rows that sort strictly before ``key``: a plain filter, no shuffle."""
    if key is None:
        return F.lit(True)
    out = F.lit(False)
    for c, v in reversed(list(zip(order, key))):
        out = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out
