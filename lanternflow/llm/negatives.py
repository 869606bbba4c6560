"""Hard negatives by zone maps over Hilbert-ordered blocks.

1. Vectors are ordered along a Hilbert curve through their components (four bits each, relative to
   the vector's own size) and written to the shared folder as Parquet files, one row group a block.
   A zone map keeps for every block its labels and the least and largest value of each dimension.
2. Anchors are dealt along the same curve; a task takes bounded chunks of them. The inner product of an anchor
   with a block lies in an interval that follows from the zone map: positive components meet the one end, negative
   components the other. Only blocks whose interval may hold a better score are read.
3. First the blocks that may hold a better positive are read, then, with the positives' scores known, the
   blocks whose interval meets an anchor's windows above the negatives that it has. The blocks of the highest
   bounds come first, so that the scores to beat are high early.

Nothing but the results leaves a task, and no vector but the ones of the block and chunk at hand is held. Files
are written under a task's own name and moved into place, so a task may run again. The shared folder must be one
that pyarrow can open by path or URI on every executor.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.session import shared_folder

BLOCK = 1024       # rows of a block
CHUNK = 2048       # anchors that a task handles together
LEVEL_BITS = 4     # bits of a component on the curve
LEAST, NOBODY = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # no score yet; no vec_id
VECTORS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64()))])


def quantised(rows: DataFrame, label: Column | None = None, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, v``: components x as floor(scale * x); rows without label or with a null or non-finite component go."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull() & ~odd)
    return whole.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"),
                        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


# The curve -------------------------------------------------------------------------------

def hilbert_keys(levels: np.ndarray, bits: int = LEVEL_BITS) -> list[bytes]:
    """Place of each row of ``levels`` (rows x dimensions, values below 2^bits) on the Hilbert curve, as sortable bytes."""
    x = levels.astype(np.uint32).T.copy()
    dims = len(x)
    if not dims:
        return [b""] * levels.shape[0]
    q = 1 << (bits - 1)
    while q > 1:  # from the coarsest bit: mirror and turn the cube that the point lies in
        low = np.uint32(q - 1)
        for i in range(dims):
            upper = (x[i] & np.uint32(q)) != 0
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & np.uint32(q), np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # bits x dims x rows
    packed = np.packbits(planes.reshape(bits * dims, -1).astype(np.uint8), axis=0).T
    return [r.tobytes() for r in np.ascontiguousarray(packed)]


def levels_of(v: np.ndarray, bits: int = LEVEL_BITS) -> np.ndarray:
    """Components on a scale of 2^bits steps around zero, relative to the root mean square of the vector."""
    size = np.sqrt(np.mean(np.square(v.astype(np.float64)), axis=1, keepdims=True)) if v.shape[1] else np.ones((len(v), 1))
    half = 1 << (bits - 1)
    return np.clip(np.floor(v / np.where(size > 0, size, 1) * (half / 2)) + half, 0, 2 * half - 1).astype(np.uint32)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as a matrix; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _keyed(vectors: DataFrame, dims: int) -> DataFrame:
    def run(batches):
        for b in batches:
            keys = hilbert_keys(levels_of(_matrix(b.column("v"), dims)))
            yield pa.record_batch([pa.array(keys, pa.binary()), *b.columns], ["key", *b.schema.names])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "key binary, vec_id long, label long, v array<long>")


# Blocks ----------------------------------------------------------------------------------

def _in_runs(batches, most: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of ``most`` rows."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, most - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_blocks(vectors: DataFrame, dims: int, files: int, block: int = BLOCK) -> str:
    """Write ``vectors`` in curve order as blocks, and their zone maps; the folder of both."""
    folder = f"{shared_folder(vectors.sparkSession).rstrip('/')}/blocks/{uuid.uuid4().hex}"

    def run(batches):
        task = TaskContext.get()
        name = f"rows-{task.partitionId():07d}.parquet"
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/rows", recursive=True)
        part, group = f"{root}/rows/.{name}.{task.taskAttemptId()}", 0
        with store.open_output_stream(part) as out, pq.ParquetWriter(out, VECTORS) as writer:
            for rows in _in_runs(batches, block):
                v = _matrix(rows.column("v"), dims)
                writer.write_table(rows.select(VECTORS.names).cast(VECTORS), row_group_size=block)
                ids = rows.column("vec_id").fill_null(NOBODY).to_numpy()
                zone = [[name], [group], [int(ids.min())], [np.unique(rows.column("label").to_numpy())], [v.min(axis=0)], [v.max(axis=0)]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zone, (
                    pa.string(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3))], ["file", "row_group", "first_id", "labels", "lo", "hi"])
                group += 1
        store.move(part, f"{root}/rows/{name}")

    (_keyed(vectors, dims).repartitionByRange(files, "key", "vec_id").sortWithinPartitions("key", "vec_id")
     .mapInArrow(run, "file string, row_group int, first_id long, labels array<long>, lo array<long>, hi array<long>")
     .write.parquet(f"{folder}/zones"))
    return folder


class Zones:
    """Zone maps of ``count`` blocks."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        self.count = batch.num_rows
        self.place = list(zip(batch.column("file").to_pylist(), batch.column("row_group").to_pylist()))
        self.lo, self.hi = (_matrix(batch.column(c), dims).astype(np.float64) for c in ("lo", "hi"))
        labels = batch.column("labels")
        self.n_labels = labels.value_lengths().to_numpy(zero_copy_only=False)
        self.block_of = np.repeat(np.arange(self.count), self.n_labels)
        self.labels = labels.flatten().to_numpy(zero_copy_only=False)


class Store:
    """The block files of a folder, as a task reads them."""

    def __init__(self, folder: str, dims: int):
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.dims, self.name, self.open = dims, None, None
        found = self.files.get_file_info(pafs.FileSelector(f"{self.root}/zones"))
        self.zone_files = sorted(f.path for f in found if f.path.endswith(".parquet") and f.base_name[0] not in "._")
        self.read_blocks = 0

    def zones(self, most: int = 1024) -> Iterator[Zones]:
        for path in self.zone_files:
            with self.files.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(most):
                    yield Zones(batch, self.dims)

    def block(self, place: tuple[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if place[0] != self.name:
            self.name = place[0]
            self.open = pq.ParquetFile(self.files.open_input_file(f"{self.root}/rows/{place[0]}"))
        rows = self.open.read_row_group(place[1])
        self.read_blocks += 1
        return rows.column("vec_id").fill_null(NOBODY).to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), self.dims)


# Search ----------------------------------------------------------------------------------

def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all of ``b``; beyond 64 bits they end at the border."""
    widest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if widest < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST + 1, NOBODY - 1).astype(np.int64)


class Best:
    """The ``k`` best (score, vec_id) of each of ``n`` places: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), LEAST), np.full((n, k), NOBODY)

    @property
    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def improves(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (places x candidates) enter the list of their place."""
        last, last_id = self.floor[at][:, None], self.id[at, -1][:, None]
        return (score > last) | ((score == last) & (ids[None, :] < last_id))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        places, k = np.unique(at), self.score.shape[1]
        every = np.concatenate([at, np.repeat(places, k)])
        score = np.concatenate([score, self.score[places].ravel()])
        ids = np.concatenate([ids, self.id[places].ravel()])
        order = np.lexsort((ids, ~score, every))  # ~x falls as x rises
        first = np.searchsorted(every[order], places)
        take = order[(first[:, None] + np.arange(k)).ravel()]
        self.score[places], self.id[places] = score[take].reshape(-1, k), ids[take].reshape(-1, k)


def share(percent: int, score: np.ndarray, up: bool) -> np.ndarray:
    """percent * score / 100 rounded down, or up, without overflow."""
    sign = -1 if up else 1
    whole, rest = np.divmod(sign * score, 100)
    return sign * (percent * whole + percent * rest // 100)


class Search:
    """Positives and negatives of one chunk of anchors."""

    def __init__(self, store: Store, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, positives: int, negatives: int, least: int, most: int):
        self.store, self.ids, self.labels, self.v = store, ids, labels, v
        self.known, self.code = np.unique(labels, return_inverse=True)
        self.up, self.down = np.maximum(v, 0).astype(np.float64), np.minimum(v, 0).astype(np.float64)
        self.keep, self.negatives, self.least, self.most = positives, negatives, least, most

    def bounds(self, z: Zones) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of the inner product of each anchor with each block, and whether the block has the anchor's label."""
        low, high = self.up @ z.lo.T + self.down @ z.hi.T, self.up @ z.hi.T + self.down @ z.lo.T
        slack = 1 + 1e-9 * np.maximum(np.abs(low), np.abs(high))  # sums beyond 2^53 may be rounded
        at = np.searchsorted(self.known, z.labels)
        at[at == len(self.known)] = 0
        same = np.zeros((len(self.known), z.count), bool)
        hit = self.known[at] == z.labels
        same[at[hit], z.block_of[hit]] = True
        return low - slack, high + slack, same[self.code]

    def _sweep(self, wanted, visit) -> None:
        """Read the blocks that ``wanted(low, high, same, n_labels)`` names for some anchor: the highest bounds first."""
        first: list = []
        for i, z in enumerate(self.store.zones()):
            low, high, same = self.bounds(z)
            need = wanted(low, high, same, z.n_labels)
            for b in np.flatnonzero(need.any(axis=0)):
                heapq.heappush(first, (high[need[:, b], b].max(), i, int(b), z.place[b], np.flatnonzero(need[:, b])))
                if len(first) > 4:
                    heapq.heappop(first)
        done = set()
        for _, i, b, place, rows in sorted(first, reverse=True, key=lambda f: f[:3]):
            visit(place, rows)
            done.add((i, b))
        for i, z in enumerate(self.store.zones()):
            low, high, same = self.bounds(z)
            for b in np.argsort(-high.max(axis=0), kind="stable"):
                cut = slice(b, b + 1)
                rows = np.flatnonzero(wanted(low[:, cut], high[:, cut], same[:, cut], z.n_labels[cut])[:, 0])
                if len(rows) and (i, int(b)) not in done:
                    visit(z.place[b], rows)

    def positives(self) -> Best:
        """The best rows of the same label, one more than asked for: an anchor meets itself."""
        best = Best(len(self.ids), self.keep + 1)

        def wanted(low, high, same, n_labels):
            return same & (high >= best.floor[:, None])

        def visit(place, rows):
            ids, labels, v = self.store.block(place)
            score = products(self.v[rows], v)
            hit = (labels[None, :] == self.labels[rows][:, None]) & best.improves(rows, score, ids)
            a, c = np.nonzero(hit)
            best.add(rows[a], score[a, c], ids[c])

        self._sweep(wanted, visit)
        own = products_with_self(self.v)
        mine = (best.id == self.ids[:, None]) & (best.score == own[:, None])
        gone = np.where(mine.any(axis=1), mine.argmax(axis=1), self.keep)  # itself, or else the last
        stay = np.arange(self.keep + 1)[None, :] != gone[:, None]
        out = Best(len(self.ids), self.keep)
        out.score, out.id = best.score[stay].reshape(-1, self.keep), best.id[stay].reshape(-1, self.keep)
        return out

    def run(self) -> list[np.ndarray]:
        """Columns of the result."""
        pos = self.positives()
        known = pos.score != LEAST
        floor, ceiling = (np.where(known, share(p, np.where(known, pos.score, 0), up), e) for p, up, e in (
            (self.least, True, NOBODY), (self.most, False, LEAST)))
        best = [Best(len(self.ids), self.negatives) for _ in range(self.keep)]

        def wanted(low, high, same, n_labels):
            need = np.zeros(low.shape, bool)
            for j, b in enumerate(best):
                need |= (high >= np.maximum(floor[:, j], b.floor)[:, None]) & (low <= ceiling[:, j][:, None])
            return need & ~(same & (n_labels == 1)[None, :])

        def visit(place, rows):
            ids, labels, v = self.store.block(place)
            score = products(self.v[rows], v)
            other = labels[None, :] != self.labels[rows][:, None]
            for j, b in enumerate(best):
                hit = other & (score >= floor[rows, j][:, None]) & (score <= ceiling[rows, j][:, None]) & b.improves(rows, score, ids)
                a, c = np.nonzero(hit)
                if len(a):
                    b.add(rows[a], score[a, c], ids[c])

        self._sweep(wanted, visit)
        score, ids = (np.stack([getattr(b, c) for b in best], axis=1) for c in ("score", "id"))
        a, p, r = np.nonzero(score != LEAST)
        return [self.ids[a], pos.id[a, p], r + 1, ids[a, p, r], pos.score[a, p], score[a, p, r]]


def products_with_self(v: np.ndarray) -> np.ndarray:
    if float(np.abs(v.astype(np.float64)).max(initial=0)) ** 2 * max(v.shape[1], 1) < 2 ** 53:
        return (v * v).sum(axis=1)
    return np.clip((v.astype(object) ** 2).sum(axis=1), LEAST + 1, NOBODY - 1).astype(np.int64)


RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchor`` names.

    ``vectors(vec_id, label, v)`` holds integer vectors (see ``quantised``). A row's score is its inner product
    with the anchor; shorter vectors count as ending in zeros. The first ``positives`` other rows of the anchor's label
    are its positives; of the rows of other labels with a score of ``least`` to ``most`` percent of a positive's, the
    first ``negatives`` are returned, higher scores first, then smaller vec_id. Rows without label or vector take no part.
    A null vec_id counts as the largest and is returned as null (so is 2^63-1). A repeated row is another row, and as
    an anchor it has results of its own. Scores end at the border of 64 bits. An empty table gives no row. Other columns
    are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("label IS NOT NULL AND v IS NOT NULL").select("vec_id", "label", "v", F.coalesce(anchor, F.lit(False)).alias("_a"))
    count, asked, dims = rows.agg(F.count(F.lit(1)), F.count_if("_a"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = write_blocks(rows, dims, max(parts, -(-count // (256 * block))), block)

    def run(batches):
        store = Store(folder, dims)
        for chunk in _in_runs(batches, CHUNK):
            found = Search(store, chunk.column("vec_id").fill_null(NOBODY).to_numpy(), chunk.column("label").to_numpy(),
                           _matrix(chunk.column("v"), dims), positives, negatives, least, most).run()
            whose = [pa.array(c.astype(np.int32) if n == "rank" else c, mask=(c == NOBODY) if n.endswith("_id") else None)
                     for n, c in zip(RESULT, found)]
            yield pa.record_batch(whose, RESULT)

    return (_keyed(rows.filter("_a"), dims).repartitionByRange(max(parts, -(-asked // CHUNK)), "key", "vec_id")
            .sortWithinPartitions("key", "vec_id").mapInArrow(
                run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
