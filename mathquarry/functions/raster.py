"""Page rasters as arrays: binary PPM in and out, difference metrics, and a marked picture of the differences."""

from __future__ import annotations

import math
import re

import numpy as np

# The grey level above which a pixel has changed, weights of a grey level, and the marks.
THRESHOLD = 24
_GREY = np.array([19595, 38470, 7471])
_TINT, _FRAME, _FRAME_WIDTH = 90 / 255, 220 / 255, 6
_PPM = re.compile(rb"P6\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s")


def read_ppm(data: bytes) -> np.ndarray:
    """height x width x 3, eight bits a channel."""
    found = _PPM.match(data)
    if not found or found[3] != b"255":
        raise ValueError("not an eight-bit binary PPM")
    width, height = int(found[1]), int(found[2])
    body = data[found.end() : found.end() + 3 * width * height]
    if len(body) != 3 * width * height:
        raise ValueError("the picture is cut off")
    return np.frombuffer(body, np.uint8).reshape(height, width, 3)


def write_ppm(picture: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (picture.shape[1], picture.shape[0]) + picture.astype(np.uint8).tobytes()


def padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both on white canvases of the larger width and height, at the top left."""
    height, width = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    grow = lambda x: np.pad(x, ((0, height - x.shape[0]), (0, width - x.shape[1]), (0, 0)), constant_values=255)
    return grow(a), grow(b)


def changed(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(absolute difference, mask of changed pixels) of two pictures of one size."""
    apart = np.abs(a.astype(np.int16) - b)
    return apart, (apart.astype(np.int64) @ _GREY + 0x8000 >> 16) > threshold


def box(mask: np.ndarray) -> dict | None:
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return {"left": int(xs[0]), "top": int(ys[0]), "right": int(xs[-1]) + 1, "bottom": int(ys[-1]) + 1} if len(xs) else None


def metrics(original: bytes, converted: bytes, threshold: int = THRESHOLD) -> dict:
    a, b = padded(read_ppm(original), read_ppm(converted))
    apart, mask = changed(a, b, threshold)
    channels = apart.reshape(-1, 3).astype(float)
    count, total = int(mask.sum()), mask.size
    return {
        "width": a.shape[1], "height": a.shape[0], "changed_pixels": count, "changed_ratio": count / total if total else 0.0,
        "mean_abs_diff": float(channels.mean()) if total else 0.0, "rms_diff": math.sqrt(float((channels**2).mean())) if total else 0.0, "diff_box": box(mask),
    }


def marked(original: bytes, converted: bytes, threshold: int = THRESHOLD) -> bytes:
    """The converted page with changed pixels tinted red and a frame around them all."""
    a, b = padded(read_ppm(original), read_ppm(converted))
    _, mask = changed(a, b, threshold)
    weight = np.where(mask, _TINT, 0.0)
    found = box(mask)
    if found:
        frame = np.zeros(mask.shape, dtype=bool)
        frame[found["top"] : found["bottom"], found["left"] : found["right"]] = True
        n = _FRAME_WIDTH
        frame[found["top"] + n : found["bottom"] - n, found["left"] + n : found["right"] - n] = False
        weight = np.where(frame & ~mask, _FRAME, weight)
    red = np.array([255.0, 0.0, 0.0])
    return write_ppm(np.rint(b * (1 - weight[..., None]) + red * weight[..., None]))
