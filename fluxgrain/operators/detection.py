"""Detection around an external detector: blobs on an image, threshold control, a resumable sweep."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrain.functions.kernels import gaussian_smooth


def _smooth2(image: np.ndarray, sigma: float) -> np.ndarray:
    rows = np.apply_along_axis(gaussian_smooth, 0, image, sigma)
    return np.apply_along_axis(gaussian_smooth, 1, rows, sigma)


def log_blobs(image: np.ndarray, sigmas: Iterable[float], least: float, top: int | None = None) -> list[tuple[int, int, float, float]]:
    """(y, x, sigma, strength) of the local maxima of the scale-normalised Laplacian of Gaussian over space and scale."""
    sigmas = list(sigmas)
    stack = []
    for s in sigmas:
        g = np.pad(_smooth2(image.astype(float), s), 1, "edge")
        stack.append(-(g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]) * s * s)
    v = np.stack(stack)
    padded = np.pad(v, 1, constant_values=-np.inf)
    peak = v >= least
    for dz in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dz or dy or dx:
                    peak &= v > padded[1 + dz : 1 + dz + v.shape[0], 1 + dy : 1 + dy + v.shape[1], 1 + dx : 1 + dx + v.shape[2]]
    found = sorted(((int(y), int(x), sigmas[z], float(v[z, y, x])) for z, y, x in np.argwhere(peak)), key=lambda b: (-b[3], b[0], b[1]))
    return found[:top]


def blobs(images: DataFrame, sigmas: tuple[float, ...] = (1.0, 1.5, 2.0, 3.0), least: float = 0.05, top: int | None = 200) -> DataFrame:
    """recording, y, x, sigma, strength from images (recording, y, x, v), scaled by their 99.5th percentile over the median."""
    kind = images.schema["recording"].dataType.simpleString()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        y, x = p["y"].to_numpy(int), p["x"].to_numpy(int)
        image = np.zeros((y.max() + 1, x.max() + 1))
        image[y, x] = p["v"]
        rest = image - np.median(image)
        scale = np.percentile(rest, 99.5)
        found = log_blobs(np.clip(rest / scale, 0, 1), sigmas, least, top) if scale > 0 else []
        out = pd.DataFrame(found, columns=["y", "x", "sigma", "strength"])
        out.insert(0, "recording", p["recording"].iloc[0])
        return out

    return images.groupBy("recording").applyInPandas(one, f"recording {kind}, y long, x long, sigma double, strength double")


@dataclass(frozen=True)
class Schedule:
    start: float = 1.0
    decay: float = 0.7
    floor: float = 0.05
    most_rois: int = 5000
    least_accept: float = 0.3
    rounds: int = 12


def adapt_threshold(detect: Callable[[float], tuple[int, float]], s: Schedule = Schedule()) -> tuple[float, list[tuple[float, int, float]]]:
    """The lowest threshold whose detection isn't over-full, and the passes taken.

    detect(threshold) gives the number of regions and the share accepted. The threshold falls by `decay` while detections are
    sound; the first over-full one (too many regions, or too few accepted) starts a binary search towards the last sound one.
    """
    passes: list[tuple[float, int, float]] = []
    good, bad, level = None, None, s.start
    for _ in range(s.rounds):
        n, share = detect(level)
        passes.append((level, n, share))
        if n > s.most_rois or (n and share < s.least_accept):
            bad = level
        else:
            good = level
        if bad is None:
            nxt = max(s.floor, level * s.decay)
        elif good is None:
            nxt = level / s.decay
        else:
            nxt = (good + bad) / 2
        if nxt == level or (good is not None and bad is not None and abs(good - bad) < 0.01 * good):
            break
        level = nxt
    return (good if good is not None else level), passes


def signature(config: dict) -> str:
    """A key of a configuration, the same whatever the order of its fields."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def pending(configs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The configurations that the ledger doesn't hold as done: what a resumed sweep has to run."""
    return configs.join(ledger.where("status = 'done'").select("sig"), "sig", "left_anti")


def footprint_traces(movie: DataFrame, pixels: DataFrame) -> DataFrame:
    """recording, roi, frame, f: lam-weighted means of a movie (recording, frame, y, x, v) over regions' pixels."""
    m = movie.join(pixels, [*(["recording"] if "recording" in pixels.columns else []), "y", "x"])
    return m.groupBy("recording", "roi", "frame").agg((F.sum(F.col("v") * F.col("lam")) / F.sum("lam")).alias("f"))
