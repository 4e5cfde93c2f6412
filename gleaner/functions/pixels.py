"""Statistics of decoded images, vectorised over each image's pixels.

Images are resized by averaging areas.  Other resizing filters give slightly different numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Grey values that count as clipped, from either end; block width of common codecs.
CLIP_LOW, CLIP_HIGH, BLOCK = 5, 250, 8


def unpack(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Red, green and blue planes of the image source's rows, which are blue first (or grey)."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def resized(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages of a grid of cells; a cell holds one pixel at least."""
    rows, cols = (np.linspace(0, n, m + 1) for n, m in zip(plane.shape, (height, width)))
    sums = np.pad(plane, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    r0, r1 = rows[:-1].astype(int), np.maximum(rows[1:].astype(int), rows[:-1].astype(int) + 1)
    c0, c1 = cols[:-1].astype(int), np.maximum(cols[1:].astype(int), cols[:-1].astype(int) + 1)
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    return total / np.outer(r1 - r0, c1 - c0)


def edge_variance(g: np.ndarray) -> float:
    """Variance of eight times each inner pixel less its neighbours, cut to a byte."""
    if min(g.shape) < 3:
        return 0.0
    near = sum(g[1 + i : g.shape[0] - 1 + i, 1 + j : g.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    return float(np.clip(9 * g[1:-1, 1:-1] - near, 0, 255).var())


def block_artifact(g: np.ndarray, most: int = 256) -> float:
    """How much more neighbours differ across block borders than inside blocks, from 0 to 1; 0 under two blocks."""
    scale = max(1.0, max(g.shape) / most)
    g = resized(g, max(1, round(g.shape[0] / scale)), max(1, round(g.shape[1] / scale))) if scale > 1 else g
    if min(g.shape) < 2 * BLOCK:
        return 0.0
    border, inside = [], []
    for d in (np.abs(np.diff(g, axis=1)), np.abs(np.diff(g, axis=0)).T):
        at = np.arange(1, d.shape[1] + 1) % BLOCK == 0
        border.append(d[:, at].ravel())
        inside.append(d[:, ~at].ravel())
    b, i = (float(np.concatenate(x).mean()) for x in (border, inside))
    return min(1.0, max(0.0, (b - i) / max(8.0, i)))


def descriptor(rgb: np.ndarray, cells: int = 4) -> list[float]:
    """Mean colours of a grid of cells, row by row, in [0, 1]."""
    planes = [resized(rgb[:, :, k], cells, cells) for k in range(3)]
    return np.round(np.stack(planes, axis=2).ravel() / 255, 5).tolist()


def average_hash(g: np.ndarray) -> str:
    """64 bits of an 8 x 8 tile against its mean, the first pixel highest."""
    tile = resized(g, 8, 8).ravel()
    return f"{int(''.join('1' if x >= tile.mean() else '0' for x in tile), 2):016x}"


FEATURES = "path string, width int, height int, mean double, midtone double, p5 double, p95 double, clipped double, edge_variance double, artifact double, hash string, descriptor array<double>"


def features_of(rgb: np.ndarray) -> dict:
    g = grey(rgb)
    values = np.sort(resized(g, 64, 64).ravel())
    mean = float(values.mean())
    return {
        "width": rgb.shape[1], "height": rgb.shape[0], "mean": mean, "midtone": max(0.0, 1 - abs(mean - 127.5) / 127.5), "p5": float(values[int(len(values) * 0.05)]), "p95": float(values[int(len(values) * 0.95)]),
        "clipped": float(((values <= CLIP_LOW) | (values >= CLIP_HIGH)).mean()), "edge_variance": edge_variance(g), "artifact": block_artifact(g), "hash": average_hash(g), "descriptor": descriptor(rgb)}


def features(images: DataFrame) -> DataFrame:
    """FEATURES of the valid rows of sources.files.decoded; ``functions.scalars`` makes scores of them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": r.path, **features_of(unpack(r.data, r.height, r.width, r.channels))} for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return images.where("valid").select("path", "width", "height", "channels", "data").mapInPandas(scan, FEATURES)
