"""Fitted objects that several catalogue queries use, kept per session and data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.catalog.views import flows
from lanternflow.functions.values import is_benign
from lanternflow.operators.scale import HotKeys, hot_keys
from lanternflow.operators.thresholds import operating_thresholds
from lanternflow.plans import detection as D
from lanternflow.session import durable

# Settings of the catalogue's detector; the SQL twin in chain.py uses the same numbers.
SEQ_LEN, TOP_N, BINS, MIN_WINDOWS, TARGET_FPR = 3, 5, 4, 30, 0.01
ABLATIONS = {"without_nll": ["nll"]}
_kept: dict = {}


def reset() -> None:
    _kept.clear()


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def benign_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).filter((F.col("split") == "train") & is_benign(F.col("label")))


def detector(spark: SparkSession, sf_dir: str) -> D.Detector:
    return once(spark, sf_dir, "detector", lambda: D.fit_detector(
        benign_train(spark, sf_dir), SEQ_LEN, TOP_N, BINS, min_windows=MIN_WINDOWS, hot=train_hot(spark, sf_dir),
        tokenizer=tokenizer(spark, sf_dir), windows=train_windows(spark, sf_dir)))


def train_hot(spark: SparkSession, sf_dir: str) -> HotKeys:
    return once(spark, sf_dir, "train_hot", lambda: hot_keys(benign_train(spark, sf_dir), ["entity_id"]))


def tokenizer(spark: SparkSession, sf_dir: str):
    from lanternflow.operators.tokens import fit_tokenizer
    return once(spark, sf_dir, "tokenizer", lambda: fit_tokenizer(
        benign_train(spark, sf_dir), TOP_N, BINS, rows=train_hot(spark, sf_dir).total))


def train_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "train_windows", lambda: D.windows_of(
        benign_train(spark, sf_dir), tokenizer(spark, sf_dir), SEQ_LEN, hot=train_hot(spark, sf_dir)))


def train_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training windows with their NLL under the fitted model."""
    from lanternflow.operators.nextevent import with_nll
    return once(spark, sf_dir, "train_scores", lambda: durable(
        with_nll(train_windows(spark, sf_dir), detector(spark, sf_dir).model)))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development and test events scored as one stream; context crosses the boundary."""
    return once(spark, sf_dir, "stream", lambda: durable(D.score_events(
        flows(spark, sf_dir).filter(F.col("split") != "train"), detector(spark, sf_dir), ABLATIONS)))


def by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with windows that restart at the split boundary."""
    return once(spark, sf_dir, "by_split", lambda: durable(D.score_events(
        flows(spark, sf_dir).filter(F.col("split") != "train"), detector(spark, sf_dir), ABLATIONS,
        keys=("split", "entity_id"))))


def stream_threshold(spark: SparkSession, sf_dir: str) -> float:
    return once(spark, sf_dir, "threshold", lambda: operating_thresholds(
        D.benign_of(stream(spark, sf_dir).filter(F.col("split") == "dev")), ["score"], TARGET_FPR)["score"])


def calibrated(spark: SparkSession, sf_dir: str, **policy) -> D.Detector:
    return replace(detector(spark, sf_dir), threshold=stream_threshold(spark, sf_dir), **policy)
