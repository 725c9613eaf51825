"""Capture quality and picture kernels on grey pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds of quality and of the two picture scans.
MIN_USABLE, MIN_RECOMMENDED, DARK, BRIGHT, BLURRY = 240, 800, 45, 225, 55
INK, AREA, BOX, ENOUGH = 180, (2, 260), 48, 12
WINDOWS, MIN_STRIDE, MIN_SCORE, BEST = (32, 40, 56, 72), 8, 0.52, 5


def assess(width: Column, height: Column, sharpness: Column, luminance: Column) -> Column:
    """struct<status, warnings>: FAIL for a picture too small to use (that warning alone), else WARN or PASS."""
    unusable = (width < MIN_USABLE) | (height < MIN_USABLE)
    warnings = F.array_compact(F.array(
        F.when((width < MIN_RECOMMENDED) | (height < MIN_RECOMMENDED), "IMAGE_TOO_SMALL"), F.when(sharpness < BLURRY, "BLURRY_IMAGE"),
        F.when(luminance < DARK, "TOO_DARK").when(luminance > BRIGHT, "TOO_BRIGHT"),
    ))
    warnings = F.when(unusable, F.array(F.lit("IMAGE_TOO_SMALL"))).otherwise(warnings)
    status = F.when(unusable, "FAIL").when(F.size(warnings) > 0, "WARN").otherwise("PASS")
    return F.struct(status.alias("status"), warnings.alias("warnings"))


def mean_luminance(pixels: Column) -> Column:
    """Mean grey value, two decimals; null for no pixels."""
    total = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(pixels) > 0, F.round(total / F.size(pixels), 2))


def _grid(pixels, width: int) -> np.ndarray:
    a = np.asarray(pixels, float)
    return a.reshape(-1, width) if width and len(a) % width == 0 else np.zeros((0, 0))


@F.pandas_udf(T.DoubleType())
def sharpness(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Population variance of the 4-neighbour Laplacian inside a grid; 0 below three rows or columns."""

    def one(p, w) -> float:
        g = _grid(p, int(w))
        if min(g.shape) < 3:
            return 0.0
        lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
        return round(float(lap.var()), 2)

    return pd.Series([None if p is None else one(p, w) for p, w in zip(pixels, width, strict=True)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def text_like_parts(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """4-connected dark parts of a letter's size, counted up to ENOUGH."""

    def one(p, w) -> int:
        dark = _grid(p, int(w)) < INK
        rows, cols = dark.shape
        seen, n = np.zeros_like(dark), 0
        for start in zip(*np.nonzero(dark), strict=True):
            if seen[start]:
                continue
            todo, part = [start], []
            seen[start] = True
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for j, i in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= j < rows and 0 <= i < cols and dark[j, i] and not seen[j, i]:
                        seen[j, i] = True
                        todo.append((j, i))
            ys, xs = zip(*part, strict=True)
            if AREA[0] <= len(part) <= AREA[1] and max(ys) - min(ys) < BOX and max(xs) - min(xs) < BOX:
                n += 1
                if n >= ENOUGH:
                    break
        return n

    return pd.Series([0 if p is None else one(p, w) for p, w in zip(pixels, width, strict=True)], dtype="int32")


def window_score(window: np.ndarray) -> float:
    """How much a window looks like a code: dark and light in balance, many changes, contrast."""
    bits = window < window.mean()
    balance = 1 - min(1.0, abs(float(bits.mean()) - 0.5) / 0.5)
    changes = (np.diff(bits, axis=0) != 0).sum() + (np.diff(bits, axis=1) != 0).sum()
    transition = min(1.0, float(changes) / (bits.size * 0.5))
    contrast = min(1.0, float(window.std()) / 96)
    return 0.35 * balance + 0.45 * transition + 0.20 * contrast


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("confidence", T.DoubleType())])))
def code_candidates(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """The best windows of a grid that may hold a code: by confidence, then from the top left."""

    def one(p, w) -> list[dict]:
        g, out = _grid(p, int(w)), []
        for size in WINDOWS:
            stride = max(MIN_STRIDE, size // 4)
            for y in range(0, g.shape[0] - size + 1, stride):
                for x in range(0, g.shape[1] - size + 1, stride):
                    s = window_score(g[y : y + size, x : x + size])
                    if s >= MIN_SCORE:
                        out.append({"x": x, "y": y, "size": size, "confidence": round(s, 3)})
        return sorted(out, key=lambda c: (-c["confidence"], c["y"], c["x"]))[:BEST]

    return pd.Series([[] if p is None else one(p, w) for p, w in zip(pixels, width, strict=True)])
