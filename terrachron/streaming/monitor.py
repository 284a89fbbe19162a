"""Near-real-time monitoring of breaks as a stream: an extension over the batch monitor.

Each pixel keeps its history's harmonic model, the error's size and the last K residuals; an observation updates the
moving sum and is reported when the sum leaves the boundary. State is a fixed number of values a pixel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..operators.breaks import monitor_critical

OUT = "pixel bigint, i int, process double, boundary double, has_break int"
STATE = "n int, nh int, seen int, sigma double, beta array<double>, window array<double>, hist_i array<int>, hist_v array<double>"


def row(i: np.ndarray, frequency: int, order: int) -> np.ndarray:
    t = np.asarray(i, float) / frequency
    return np.stack([np.ones_like(t), t * frequency + 1, *[f(2 * np.pi * k * t) for f in (np.cos, np.sin) for k in range(1, order + 1)]], axis=-1)


def stream_monitor(obs: DataFrame, *, history: int, frequency: int, order: int = 1, h: float = 0.25, period: int = 10, alpha: float = 0.05) -> DataFrame:
    """obs: a stream (pixel, i step, v). The first `history` steps of a pixel fit its model; later ones give OUT rows.
    Observations are taken in order of i within a batch; late ones (a step already passed) are left out."""
    crit = monitor_critical(h, period, alpha)

    def update(key, frames, state):
        import pandas as pd

        n, nh, seen, sigma, beta, window, hi, hv = state.get if state.exists else (0, 0, -1, 0.0, [], [], [], [])
        beta, window, hi, hv = list(beta), list(window), list(hi), list(hv)
        out = []
        rows = sorted((int(i), float(v)) for f in frames for i, v in zip(f["i"], f["v"]) if v == v and v is not None)
        for i, v in rows:
            if i <= seen:
                continue
            seen = i
            if i < history:
                hi.append(i)
                hv.append(v)
                continue
            if not beta and hi:
                x, y = row(np.array(hi), frequency, order), np.array(hv)
                nh = n = len(y)
                if nh > x.shape[1] and int(h * nh) > 1:
                    b = np.linalg.lstsq(x, y, rcond=None)[0]
                    e = y - x @ b
                    sigma, beta, window = float(np.sqrt(e @ e / (nh - x.shape[1]))), b.tolist(), e[-int(h * nh) :].tolist()
                hi, hv = [], []
            if not beta or sigma <= 0:
                continue
            n += 1
            window = [*window[1:], v - float(row(np.array([i]), frequency, order)[0] @ np.array(beta))]
            proc = sum(window) / (sigma * math.sqrt(nh))
            ratio = n / nh
            bound = crit * math.sqrt(2 * (1.0 if ratio <= math.e else math.log(ratio)))
            out.append((key[0], i, proc, bound, int(abs(proc) > bound)))
        state.update((n, nh, seen, sigma, beta, window, hi, hv))
        yield pd.DataFrame(out, columns=["pixel", "i", "process", "boundary", "has_break"])

    return obs.groupBy("pixel").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")
