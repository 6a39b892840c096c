"""Places where the caller plugs in Python: a model, and pixel statistics of Spark's image source."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score(df: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """Runs a caller's model over Arrow batches; ``load_model`` is called once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for pdf in batches:
            yield predict(pdf)

    return df.mapInPandas(run, schema)


def _lightness(raw: bytes, channels: int) -> np.ndarray:
    """CIE lightness of 8-bit sRGB pixels in BGR order, scaled to 0..255."""
    px = np.frombuffer(raw, dtype=np.uint8).astype(np.float64) / 255.0
    px = np.where(px <= 0.04045, px / 12.92, ((px + 0.055) / 1.055) ** 2.4)
    if channels >= 3:
        bgr = px.reshape(-1, channels)
        px = 0.072169 * bgr[:, 0] + 0.715160 * bgr[:, 1] + 0.212671 * bgr[:, 2]
    light = np.where(px > 0.008856, 116.0 * np.cbrt(px) - 16.0, 903.3 * px)
    return light * 2.55


LUMA = T.StructType([T.StructField("mean_l", T.DoubleType()), T.StructField("std_l", T.DoubleType())])


@F.pandas_udf(LUMA)
def luma_stats(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Mean and deviation of lightness per image of Spark's image source."""

    def one(raw: bytes, n: int) -> tuple[float, float]:
        light = _lightness(raw, n)
        return (float(light.mean()), float(light.std())) if light.size else (0.0, 0.0)

    return pd.DataFrame([one(d, n) for d, n in zip(data, channels)], columns=["mean_l", "std_l"])
