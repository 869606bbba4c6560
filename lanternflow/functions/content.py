"""Content statistics for files and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bits(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum()) + 0.0


def symbol_entropy(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Shannon entropy in bits over the characters of a text, one row per key; null and empty texts have 0.

    One pass over the code points of each text, whatever the size of its alphabet.
    """
    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float:
            if not t:
                return 0.0
            points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            few = points.max() < 4096
            return _bits(np.bincount(points) if few else np.unique(points, return_counts=True)[1])
        return texts.map(one)

    return df.select(key, entropy(text).alias("entropy"))


def byte_entropy(content: Column, limit: int | None = None) -> Column:
    """Shannon entropy in bits over all bytes of a binary column, or over the first ``limit``."""
    @F.pandas_udf("double")
    def entropy(blobs: pd.Series) -> pd.Series:
        def one(blob: bytes | None) -> float:
            if not blob:
                return 0.0
            seen = np.frombuffer(blob, np.uint8)[:limit]
            return _bits(np.bincount(seen, minlength=256))
        return blobs.map(one)

    return entropy(content)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)
