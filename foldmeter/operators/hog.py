"""Histogram of oriented gradients.

``images`` is (image_id, height, width, channels, pixels array<double>) with pixels row by row.  An image is one row and its
features are computed where it lies: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Block norms and their constants.
BLOCK_NORMS = ("L1", "L1-sqrt", "L2", "L2-Hys")
EPS = 1e-5
CLIP = 0.2


def _gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and angle in degrees [0, 180) per pixel, of the channel with the strongest gradient, the first of equals.

    Differences are taken between the neighbours on both sides; the image's border has none.
    """
    gy, gx = np.zeros_like(image), np.zeros_like(image)
    gy[1:-1] = image[2:] - image[:-2]
    gx[:, 1:-1] = image[:, 2:] - image[:, :-2]
    square = gx * gx + gy * gy
    best = square.argmax(axis=2)[:, :, None]
    angle = np.degrees(np.arctan2(np.take_along_axis(gy, best, 2), np.take_along_axis(gx, best, 2)))[:, :, 0] % 180.0
    return np.sqrt(np.take_along_axis(square, best, 2)[:, :, 0]), np.where(angle >= 180.0, 0.0, angle)


def _histograms(size: np.ndarray, angle: np.ndarray, bins: int, cell_h: int, cell_w: int) -> np.ndarray:
    """(cell rows, cell columns, bins): mean gradient per pixel of every whole cell."""
    rows, cols = size.shape[0] // cell_h, size.shape[1] // cell_w
    size, angle = size[: rows * cell_h, : cols * cell_w], angle[: rows * cell_h, : cols * cell_w]
    slot = np.floor(angle / (180.0 / bins)).astype(np.int64)
    cell = (np.arange(rows * cell_h) // cell_h)[:, None] * cols + (np.arange(cols * cell_w) // cell_w)[None, :]
    inside = slot < bins
    sums = np.bincount((cell * bins + slot)[inside], weights=size[inside], minlength=rows * cols * bins)
    return sums.reshape(rows, cols, bins) / (cell_h * cell_w)


def _normed(blocks: np.ndarray, norm: str) -> np.ndarray:
    """Rows of block values at unit length."""
    if norm.startswith("L1"):
        out = blocks / (np.abs(blocks).sum(axis=1, keepdims=True) + EPS)
        return np.sqrt(out) if norm == "L1-sqrt" else out
    l2 = lambda b: b / np.sqrt((b * b).sum(axis=1, keepdims=True) + EPS**2)
    return l2(np.minimum(l2(blocks), CLIP)) if norm == "L2-Hys" else l2(blocks)


def hog_features(
    images: DataFrame,
    bins: int = 9,
    cell_width: int = 8,
    cell_height: int = 8,
    block_width: int = 3,
    block_height: int = 3,
    norm: str = "L2-Hys",
) -> DataFrame:
    """(image_id, features array<double>): blocks row by row, cells of a block row by row, bins.

    An image without a whole block has no features: an empty array.
    """
    if norm not in BLOCK_NORMS:
        raise ValueError(f"norm must be one of {BLOCK_NORMS}")
    if min(bins, cell_width, cell_height, block_width, block_height) < 1:
        raise ValueError("bins, cell and block sizes must be at least 1")

    def features(height, width, channels, pixels) -> np.ndarray:
        if not (height and width and channels) or pixels is None:
            return np.zeros(0)
        hist = _histograms(*_gradients(pixels.reshape(height, width, channels)), bins, cell_height, cell_width)
        down, across = hist.shape[0] - block_height + 1, hist.shape[1] - block_width + 1
        if down < 1 or across < 1:
            return np.zeros(0)
        windows = np.lib.stride_tricks.sliding_window_view(hist, (block_height, block_width), axis=(0, 1))
        values = windows.transpose(0, 1, 3, 4, 2).reshape(down * across, -1)
        return _normed(values, norm).ravel()

    def of_images(batches):
        for batch in batches:
            shape = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            values = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            known = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            out = [
                features(h, w, c, values[(ends[i - 1] if i else 0) : ends[i]] if known[i] else None) for i, (h, w, c) in enumerate(zip(*shape))
            ]
            at = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
            flat = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), flat)], names=["image_id", "features"])

    kind = images.schema["image_id"].dataType.simpleString()
    columns = images.selectExpr("image_id", "int(height) AS height", "int(width) AS width", "int(channels) AS channels", "pixels")
    return columns.mapInArrow(of_images, f"image_id {kind}, features array<double>")
