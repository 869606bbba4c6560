"""Hierarchical language identification: first the family, then the language within it.

Features are the square roots of the relative frequencies of hashed character n-grams (1 to 3)
of the whole lower-cased text, a vector of length one. One linear support vector machine is trained
for each pair of families, and one for each pair of languages of a family. Pairs vote; ties go
to the larger sum of margins.

Training uses at most about ``per_language`` labelled rows of each language, chosen by a hash of their
id, so the cost of fitting is bounded; the counts behind the choice cover all rows. Each machine is
trained in a task of its own. The weights are a few small vectors, which every task gets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import boxed, durable

# Language codes by family. A code that is missing is a family by itself.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
UNKNOWN = "und"
DIMS = 2048
COST = 10.0        # of a training row inside the margin
_LETTER = regex.compile(r"\p{L}")
_ASCII = np.array([c if chr(c).isalpha() or chr(c) == "'" else 32 for c in range(128)], np.uint32)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def slots(text: str | None) -> np.ndarray | None:
    """Hashed n-gram places of a text, or None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    h1 = c * np.uint32(0x9E3779B1)
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h1[1:]
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + h1[2:]
    every = np.concatenate([h1, h2 * np.uint32(0x27D4EB2F), h3 * np.uint32(0x165667B1)])
    return (every >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the relative n-gram frequencies: a vector of length one."""
    at = slots(text)
    return None if at is None else np.sqrt(np.bincount(at, minlength=DIMS) / len(at))


@dataclass(frozen=True)
class Decision:
    """One support vector machine: a positive margin means ``a``."""

    a: str
    b: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class LanguageModel:
    families: dict[str, tuple[str, ...]]             # languages learnt, by family
    between: tuple[Decision, ...]                    # pairs of families
    within: dict[str, tuple[Decision, ...]]          # pairs of languages of a family

    @staticmethod
    def _vote(names: Sequence[str], decisions: Sequence[Decision], x: np.ndarray) -> tuple[str, float]:
        """Winner and the chance, by the logistic of its weakest margin, that it is right."""
        if len(names) == 1:
            return names[0], 1.0
        wins, margins, weakest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, math.inf)
        for d in decisions:
            m = float(x @ d.weights + d.bias)
            wins[d.a if m > 0 else d.b] += 1
            for name, margin in ((d.a, m), (d.b, -m)):
                margins[name] += margin
                weakest[name] = min(weakest[name], margin)
        best = max(names, key=lambda n: (wins[n], margins[n], n))
        return best, 1 / (1 + math.exp(-max(-50.0, min(50.0, 2 * weakest[best]))))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score 0 to 1); ``und`` and 0 for a text that is null or has no letter."""
        x = features(text) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        family, p = self._vote(sorted(self.families), self.between, x)
        lang, q = self._vote(self.families[family], self.within.get(family, ()), x)
        return lang, p * q


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = 60) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss), the bias last.

    Dual coordinate descent over the rows in their order; ``y`` is 1 or -1.
    """
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(x))
    ridge = 1 / (2 * cost)
    diagonal = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1 + ridge
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(x)):
            gradient = y[i] * (x[i] @ w + bias) - 1 + ridge * alpha[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if (step := new - alpha[i]) != 0.0:
                w += step * y[i] * x[i]
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.append(w, bias)


def fit_languages(labelled: DataFrame, per_language: int = 1000) -> LanguageModel:
    """Train on ``labelled(doc_id, text, lang)``; rows with a null text or lang are left out.

    At most about ``per_language`` rows of each language are used, chosen by a hash of doc_id.
    Without usable rows the model knows no language and answers ``und``.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    families: dict[str, tuple[str, ...]] = {}
    for lang in sorted(counts):
        families[family_of(lang)] = (*families.get(family_of(lang), ()), lang)
    # (level, a, b): a decision; a row serves every decision that its family or language is part of.
    names = [("", a, b) for a, b in combinations(sorted(families), 2)]
    names += [(f, a, b) for f, members in families.items() for a, b in combinations(members, 2)]
    if not names:
        return LanguageModel(families, (), {})
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    serves = spark.createDataFrame(
        [(lang, level, a, b, 1.0 if (family_of(lang) if level == "" else lang) == a else -1.0) for level, a, b in names for lang in counts
         if (family_of(lang) if level == "" else lang) in (a, b)], "lang string, level string, a string, b string, y double")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (x := features(t)) is None else x.astype(np.float32).tobytes())

    packed = packed.asNondeterministic()  # else a filter on its result is pushed below and computes it again

    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    sample = durable(chosen.select("doc_id", "lang", packed(F.col("text")).alias("x")).filter("x IS NOT NULL"))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "lang", "x"])
        # Both sides in turn, so that neither is seen in one long run.
        group = group.iloc[np.argsort(group.groupby("y").cumcount().to_numpy(), kind="stable")]
        x = np.empty((len(group), DIMS), np.float32)
        for i, packed_row in enumerate(group["x"]):
            x[i] = np.frombuffer(packed_row, np.float32)
        w = train_machine(x, group["y"].to_numpy())
        return pd.DataFrame({"level": group["level"].iloc[:1], "a": group["a"].iloc[:1], "b": group["b"].iloc[:1], "w": [w]})

    learnt = (sample.join(F.broadcast(serves), "lang").groupBy("level", "a", "b")
              .applyInPandas(train, "level string, a string, b string, w array<double>").collect())
    decisions = {(r["level"], r["a"], r["b"]): Decision(r["a"], r["b"], np.array(r["w"][:-1]), r["w"][-1]) for r in learnt}
    # A decision without a usable row is left out; its votes go to nobody.
    at = lambda level: tuple(decisions[n] for n in names if n[0] == level and n in decisions)
    return LanguageModel(families, at(""), {f: at(f) for f in families})


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred, score`` to ``docs(text, ...)``, from the whole text alone.

    Null texts and texts without a letter get ``und`` and 0. Other columns stay; columns of these
    two names are replaced. Equal texts get equal answers.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang", "score"])

    predict = predict.asNondeterministic()  # as above: once a row, even if the caller filters by it

    return (boxed(docs, "lang_pred", "score").withColumn("_p", predict(F.col("_row.text")))
            .select("_row.*", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4
