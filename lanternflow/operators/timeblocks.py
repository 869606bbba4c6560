"""The cooldown walk of one long uninterrupted sequence, over many tasks.

Which instants the greedy walk keeps depends on the last one kept, so a sequence looks serial. But a block of
consecutive instants needs to know only that one instant X from before it: its walk begins at the first instant
from X + gap on. So a block is a step function from the last instant kept on entry to the last one kept
on exit, with at most as many steps as there are instants within one gap of its start, and fewer as walks meet.

1. The sequences are cut into blocks by a range shuffle, and every block computes its function.
2. ``FAN`` neighbouring functions are composed into one, and again, until each sequence has one.
3. From the top down, each function gives the entries of the ones it was composed of.
4. Every block, now with its entry known, marks what it keeps.

All four steps run in parallel over blocks; the number of composing rounds is the logarithm of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.operators.scale import CHUNK, range_chunks
from lanternflow.session import durable

FAN = 64
START = np.iinfo(np.int64).min // 2   # nothing kept yet
_KEY = ["entity_id", "segment"]
_MAP = "entity_id string, segment long, block long, steps array<long>, exits array<long>, first_at long"


def successors(at: np.ndarray, gap: int) -> np.ndarray:
    """Index of the first instant at least ``gap`` later, or the length."""
    return np.searchsorted(at, at + gap)


def block_function(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, exits): a walk that may begin from any instant up to ``steps[i]`` ends with ``exits[i]`` kept."""
    n = len(at)
    nxt = successors(at, gap)
    end = np.where(nxt < n, nxt, np.arange(n))
    while not np.array_equal(end[end], end):
        end = end[end]
    entries = np.searchsorted(at, at[0] + gap) + 1
    steps, exits = at[:entries], at[end[:entries]]
    last = np.r_[exits[1:] != exits[:-1], True]
    return steps[last], exits[last]


def apply_function(steps: np.ndarray, exits: np.ndarray, entry: np.ndarray, gap: int) -> np.ndarray:
    """Last instant kept after the block for each last instant kept before it."""
    i = np.searchsorted(steps, entry + gap)
    return np.where(i < len(steps), exits[np.minimum(i, len(steps) - 1)], entry)


def _grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups of a partition sorted by ``keys``, across the borders of batches."""
    held: list[pd.DataFrame] = []
    last = None
    for rows in frames:
        if rows.empty:
            continue
        cols = [rows[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip(np.r_[0, new], np.r_[new, len(rows)]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield last, pd.concat(held)
                held = []
            last = key
            held.append(rows.iloc[lo:hi])
    if held:
        yield last, pd.concat(held)


def _functions(gap: int):
    def run(frames):
        for (entity, segment, block), rows in _grouped(frames, [*_KEY, CHUNK]):
            at = rows["at"].to_numpy()
            steps, exits = block_function(at, gap)
            yield pd.DataFrame({"entity_id": [entity], "segment": [segment], "block": [block], "steps": [steps], "exits": [exits],
                                "first_at": [at[0]]})
    return run


def _compose(gap: int):
    """One function for each run of neighbouring ones: the steps of the first, pushed through the others."""
    def run(frames):
        key, steps, at, first = None, None, None, None
        done = lambda: pd.DataFrame({"entity_id": [key[0]], "segment": [key[1]], "block": [key[2]], "steps": [steps], "exits": [at],
                                     "first_at": [first]})
        for rows in frames:
            for entity, segment, group, s, e, start in zip(*[rows[c] for c in (*_KEY, "group", "steps", "exits", "first_at")]):
                if (entity, segment, group) != key:
                    if key is not None:
                        yield done()
                    key, steps, at, first = (entity, segment, group), s, e, start
                    continue
                at = apply_function(s, e, at, gap)
                if steps[-1] < first + gap:  # the run is shorter than the gap: a walk may begin in the next block
                    new = int(np.searchsorted(s, first + gap)) + 1
                    steps, at = np.r_[steps, s[:new]], np.r_[at, e[:new]]
                merged = np.r_[at[1:] != at[:-1], True]
                steps, at = steps[merged], at[merged]
        if key is not None:
            yield done()
    return run


def _entries(gap: int):
    """The last instant kept before each function of a run, from the one before the run."""
    def run(frames):
        key, at = None, START
        for rows in frames:
            out = []
            for entity, segment, group, block, s, e, x in zip(*[rows[c] for c in (*_KEY, "group", "block", "steps", "exits", "entry")]):
                if (entity, segment, group) != key:
                    key, at = (entity, segment, group), x
                out.append((entity, segment, block, at))
                at = int(apply_function(s, e, np.array([at]), gap)[0])
            yield pd.DataFrame(out, columns=[*_KEY, "block", "entry"])
    return run


def _mark(gap: int):
    def run(frames):
        for _, rows in _grouped(frames, [*_KEY, CHUNK]):
            at = rows["at"].to_numpy()
            nxt, i, keep = successors(at, gap).tolist(), int(np.searchsorted(at, int(rows["entry"].iloc[0]) + gap)), []
            while i < len(at):
                keep.append(i)
                i = nxt[i]
            yield rows.iloc[keep][["event_row_id"]]
    return run


def _by_block(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(*order[:3]).sortWithinPartitions(*order)


def walk_in_blocks(instants: DataFrame, seconds: int, blocks: int) -> DataFrame:
    """``event_row_id`` of the instants that the greedy walk keeps, with about ``blocks`` blocks over all sequences.

    ``instants(entity_id, segment, at, event_row_id)`` has distinct ``at`` (microseconds) in each segment.
    """
    gap = seconds * 1_000_000
    rows = instants.select("entity_id", F.col("segment").cast("long").alias("segment"), F.col("at").cast("long").alias("at"), "event_row_id")
    placed = range_chunks(rows, [*_KEY, "at"], max(2, blocks)).select(*_KEY, F.col(CHUNK).cast("long").alias(CHUNK), "at", "event_row_id")
    level = durable(_by_block(placed.select(*_KEY, CHUNK, "at"), *_KEY, CHUNK, "at").mapInPandas(_functions(gap), _MAP))
    levels, spread = [], placed.agg(F.max(CHUNK)).first()[0] + 1
    while spread > 1:
        grouped = level.withColumn("group", F.floor(F.col("block") / FAN).cast("long"))
        levels.append(grouped)
        spread = -(-spread // FAN)
        if spread > 1:
            level = durable(_by_block(grouped, *_KEY, "group", "block").mapInPandas(_compose(gap), _MAP))
    entry = None
    for grouped in reversed(levels):
        known = (grouped.withColumn("entry", F.lit(START)) if entry is None else
                 grouped.join(entry.withColumnRenamed("block", "group"), [*_KEY, "group"]))
        entry = durable(_by_block(known, *_KEY, "group", "block").mapInPandas(_entries(gap), "entity_id string, segment long, block long, entry long"))
    marked = placed.join(entry.withColumnRenamed("block", CHUNK), [*_KEY, CHUNK])
    return _by_block(marked, *_KEY, CHUNK, "at").mapInPandas(_mark(gap), "event_row_id bigint")
