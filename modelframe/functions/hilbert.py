"""Instantaneous trendline by a discrete Hilbert transform, one series at a time.

The period of the dominant cycle is measured bar by bar with feedback, which no SQL fold expresses readably, so each
series runs through `applyInPandas`. Published coefficients of the transform: 0.0962 and 0.5769.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the published method: transform taps, bars before the first value, longest and shortest period.
TAPS = (0.0962, 0.0, 0.5769, 0.0, -0.5769, 0.0, -0.0962)
WARM_UP, LONGEST, SHORTEST = 63, 50.0, 6.0


def trendline(price: np.ndarray) -> np.ndarray:
    """NaN during warm-up."""
    n = len(price)
    smooth = np.array([np.dot(price[max(0, t - 3) : t + 1][::-1], (4, 3, 2, 1)[: min(t, 3) + 1]) / 10 if t >= 3 else price[t] for t in range(n)])
    detrended, q1, i1 = np.zeros(n), np.zeros(n), np.zeros(n)
    period, held, re, im, i2, q2 = SHORTEST, SHORTEST, 0.0, 0.0, 0.0, 0.0
    means, out = np.zeros(n), np.full(n, np.nan)

    def transform(x: np.ndarray, t: int, scale: float) -> float:
        return scale * sum(c * x[t - k] for k, c in enumerate(TAPS) if t >= k)

    for t in range(n):
        scale = 0.075 * period + 0.54
        detrended[t] = transform(smooth, t, scale) if t >= 6 else 0.0
        q1[t] = transform(detrended, t, scale)
        i1[t] = detrended[t - 3] if t >= 3 else 0.0
        new_i = i1[t] - transform(q1, t, scale)
        new_q = q1[t] + transform(i1, t, scale)
        last_i, last_q = i2, q2
        i2, q2 = 0.2 * new_i + 0.8 * i2, 0.2 * new_q + 0.8 * q2
        re = 0.2 * (i2 * last_i + q2 * last_q) + 0.8 * re
        im = 0.2 * (i2 * last_q - q2 * last_i) + 0.8 * im
        last = period
        if im and re and math.atan(im / re):
            period = 2 * math.pi / math.atan(im / re)
        period = min(max(min(max(period, 0.67 * last), 1.5 * last), SHORTEST), LONGEST)
        period = 0.2 * period + 0.8 * last
        held = 0.33 * period + 0.67 * held
        size = max(1, int(held + 0.5))
        means[t] = price[max(0, t - size + 1) : t + 1].mean()
        if t >= WARM_UP:
            out[t] = (4 * means[t] + 3 * means[t - 1] + 2 * means[t - 2] + means[t - 3]) / 10
    return out


def ht_trendline(df: DataFrame, keys: list[str], order: str, value: str, name: str = "ht_trendline") -> DataFrame:
    """Rows (keys, order, name), null during warm-up."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, order])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        found = pd.Series(trendline(rows[value].to_numpy(float)), index=rows.index)
        return rows[[*keys, order]].assign(**{name: found.astype(object).where(found.notna(), None)})

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, {name} double")
