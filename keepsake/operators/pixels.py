"""Pictures as arrays of pixels: the window to crop to, and colours of a small palette, many pictures at once.

A picture is a row: id, width, height, pixels (RGB bytes, row by row); decoding files is not this module's
work. Spark deals the rows; a task stacks pictures of one size and works on the stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What a six-colour display shows for black, white, yellow, red, none, blue and green.
SIX_COLOURS = ((0, 0, 0), (255, 255, 255), (164, 154, 49), (126, 39, 39), None, (31, 71, 139), (54, 78, 68))
#: Bytes of pixels that are worked on together.
STACK = 8 << 20
#: sRGB and Lab for the white point D65, as published.
TO_XYZ = np.array([[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]])
FROM_XYZ = np.array([[3.2406, -1.5372, -0.4986], [-0.9689, 1.8758, 0.0415], [0.0557, -0.2040, 1.0570]])
WHITE = np.array([0.95047, 1.0, 1.08883])
LUMA = np.array([0.299, 0.587, 0.114])
#: Shares of a pixel's error by (columns ahead, rows down).
ATKINSON = {(1, 0): 1 / 8, (2, 0): 1 / 8, (-1, 1): 1 / 8, (0, 1): 1 / 8, (1, 1): 1 / 8, (0, 2): 1 / 8}
FLOYD_STEINBERG = {(1, 0): 7 / 16, (-1, 1): 3 / 16, (0, 1): 5 / 16, (1, 1): 1 / 16}


def stacks(pictures: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray | list]], schema: str) -> DataFrame:
    """id and what ``work`` makes of stacks (pictures x height x width x 3) of pictures of one size.

    Pictures whose pixels are null or not of their size, and those without any, are left out.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w, h, p) for i, w, h, p in zip(*(c.to_pylist() for c in b.columns), strict=True) if p and w and h and len(p) == 3 * w * h]
            for w, h in sorted({r[1:3] for r in rows}):
                own = [r for r in rows if r[1:3] == (w, h)]
                step = max(1, STACK // (3 * w * h))
                for part in (own[k : k + step] for k in range(0, len(own), step)):
                    made = work(np.stack([np.frombuffer(r[3], np.uint8).reshape(h, w, 3) for r in part]))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], b.schema.field(0).type), *(pa.array(v) for v in made.values())], names=["id", *names])

    return pictures.select("id", "width", "height", "pixels").mapInArrow(run, f"id {pictures.schema['id'].dataType.simpleString()}, {schema}")


def salience(images: np.ndarray) -> np.ndarray:
    """How much each pixel draws the eye: steps in brightness to the right and down, and a part of its colourfulness."""
    light = images @ LUMA
    steps = np.zeros(light.shape)
    steps[:, :, :-1] += np.abs(np.diff(light, axis=2))
    steps[:, :-1] += np.abs(np.diff(light, axis=1))
    return steps + 0.35 * (images.max(axis=3).astype(float) - images.min(axis=3))


def window_sums(values: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, height: int) -> np.ndarray:
    """Sums over windows at (x, y) of each array of a stack: four look-ups in summed areas."""
    area = np.zeros((values.shape[0], values.shape[1] + 1, values.shape[2] + 1))
    area[:, 1:, 1:] = values.cumsum(axis=1).cumsum(axis=2)
    return area[:, y + height, x + width] - area[:, y, x + width] - area[:, y + height, x] + area[:, y, x]


def crop_windows(pictures: DataFrame, width: int, height: int) -> DataFrame:
    """(id, x, y, crop_width, crop_height): the largest window of the shape ``width`` to ``height`` that holds most of what draws the eye.

    A window's score is its share of the picture's salience less a part for its middle's distance from the
    picture's (a little above it, where rows are cut). Windows begin every 64th of the way at least; of equal
    scores the first wins, the middle and the last place coming after the others. Large pictures are meant to
    come scaled.
    """
    shape = width / height

    def work(images: np.ndarray) -> dict[str, np.ndarray]:
        n, h, w = images.shape[:3]
        wide = w / h > shape
        cut_w, cut_h = (int(h * shape + 0.5), h) if wide else (w, int(w / shape + 0.5))
        if abs(w / h - shape) < 1e-6 or not 0 < (cut_w if wide else cut_h) < (w if wide else h):
            cut_w, cut_h = w, h
        most = (w - cut_w) + (h - cut_h)  # one of them is zero
        at = np.array(list(dict.fromkeys([*range(0, most + 1, max(1, most // 64)), most // 2, most])))
        x, y = (at, 0 * at) if wide else (0 * at, at)
        drawn = salience(images)
        total = drawn.sum(axis=(1, 2))[:, None]
        share = np.divide(window_sums(drawn, x, y, cut_w, cut_h), total, out=np.zeros((n, len(at))), where=total > 0)
        off = np.abs((x + cut_w / 2) / w - 0.5) * 0.18 + np.abs((y + cut_h / 2) / h - (0.5 if wide else 0.42)) * 0.28
        best = (share - off).argmax(axis=1)
        return {"x": x[best].astype(np.int32), "y": y[best].astype(np.int32), "w": np.full(n, cut_w, np.int32), "h": np.full(n, cut_h, np.int32)}

    return stacks(pictures, work, "x int, y int, crop_width int, crop_height int")


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """Bytes of sRGB (last axis) as CIE Lab."""
    v = np.asarray(rgb, dtype=float) / 255
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = linear @ TO_XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """The way back, cut to bytes."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([lab[..., 1] / 500 + y, y, y - lab[..., 2] / 200], axis=-1)
    linear = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * WHITE @ FROM_XYZ.T
    v = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.maximum(linear, 0) ** (1 / 2.4) - 0.055)
    return np.clip(v * 255, 0, 255).astype(np.uint8)


def colour_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """CIEDE2000 of Lab colours (last axis), as published by Sharma and others in 2005."""
    (l1, a1, b1), (l2, a2, b2) = (np.moveaxis(np.asarray(x, dtype=float), -1, 0) for x in (a, b))
    seven = lambda c: np.sqrt(c**7 / (c**7 + 25.0**7))
    turn = 1.5 - 0.5 * seven((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2)
    c1, c2 = np.hypot(a1 * turn, b1), np.hypot(a2 * turn, b2)
    h1, h2 = (np.degrees(np.arctan2(y, x * turn)) % 360 for x, y in ((a1, b1), (a2, b2)))
    grey = c1 * c2 == 0
    apart = np.where(grey, 0, (h2 - h1 + 180) % 360 - 180)
    apart = np.where(~grey & (h2 - h1 == 180), 180, apart)
    middle = np.where(grey, h1 + h2, np.where(np.abs(h1 - h2) <= 180, (h1 + h2) / 2, (h1 + h2 + np.where(h1 + h2 < 360, 360, -360)) / 2))
    dl, dc, dh = l2 - l1, c2 - c1, 2 * np.sqrt(c1 * c2) * np.sin(np.radians(apart / 2))
    light, chroma, cos = (l1 + l2) / 2, (c1 + c2) / 2, lambda degrees: np.cos(np.radians(degrees))
    t = 1 - 0.17 * cos(middle - 30) + 0.24 * cos(2 * middle) + 0.32 * cos(3 * middle + 6) - 0.2 * cos(4 * middle - 63)
    dl = dl / (1 + 0.015 * (light - 50) ** 2 / np.sqrt(20 + (light - 50) ** 2))
    dc, dh = dc / (1 + 0.045 * chroma), dh / (1 + 0.015 * chroma * t)
    rotation = -np.sin(np.radians(60 * np.exp(-(((middle - 275) / 25) ** 2)))) * 2 * seven(chroma)
    return np.sqrt(np.maximum(0, dl**2 + dc**2 + dh**2 + rotation * dc * dh))


class Palette:
    """Colours by their places; a place may be none."""

    def __init__(self, colours: tuple[tuple[int, int, int] | None, ...]) -> None:
        self.places = np.array([k for k, c in enumerate(colours) if c is not None])
        self.rgb = np.array([c for c in colours if c is not None], dtype=float)
        self.lab = to_lab(self.rgb)

    def nearest(self, rgb: np.ndarray) -> np.ndarray:
        """Which colour is least far in Lab, of equal ones the first; not yet its place."""
        return ((to_lab(rgb)[..., None, :] - self.lab) ** 2).sum(axis=-1).argmin(axis=-1)


def boosted(images: np.ndarray, by: float) -> np.ndarray:
    """Pictures with stronger colours at the same brightness."""
    return from_lab(to_lab(images) * np.array([1, by, by]))


@lru_cache(maxsize=2)
def spread_thresholds(size: int = 32, sigma: float = 1.5) -> np.ndarray:
    """Thresholds 0 to 255 in an order that fills the widest gap of a tile first, so that neighbours differ most."""
    step = np.minimum(np.arange(size), size - np.arange(size))
    near = np.exp(-(step[:, None] ** 2 + step[None, :] ** 2) / (2 * sigma**2))
    energy, out = np.zeros((size, size)), np.zeros((size, size), dtype=np.uint8)
    for rank in range(size * size):
        y, x = divmod(int(energy.argmin()), size)
        out[y, x] = rank * 255 // (size * size - 1)
        energy += np.roll(near, (y, x), (0, 1))
        energy[y, x] = np.inf
    return out


def shifted(images: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Pictures with a tile of shifts added over and over."""
    n, h, w = images.shape[:3]
    tiled = np.tile(shift, (-(-h // shift.shape[0]), -(-w // shift.shape[1])))[:h, :w]
    return np.clip(images + tiled[None, :, :, None], 0, 255).astype(np.uint8)


def diffused(images: np.ndarray, palette: Palette, shares: dict[tuple[int, int], float], serpentine: bool) -> np.ndarray:
    """Nearest colours where each pixel's error goes on to pixels that follow: one pixel of all pictures at a time."""
    n, h, w = images.shape[:3]
    left, out = images.astype(float), np.zeros((n, h, w), dtype=np.int64)
    for y in range(h):
        ahead = -1 if serpentine and y % 2 else 1
        for x in range(w)[::ahead]:
            chosen = out[:, y, x] = palette.nearest(left[:, y, x].astype(np.uint8))
            error = left[:, y, x] - palette.rgb[chosen]
            for (dx, dy), share in shares.items():
                if 0 <= x + ahead * dx < w and y + dy < h:
                    to = left[:, y + dy, x + ahead * dx]
                    np.clip(to + error * share, 0, 255, out=to)
    return out


def in_colours(images: np.ndarray, palette: Palette, mode: str) -> np.ndarray:
    """Each pixel's place in the palette. Modes: direct, ordered, blue_noise, atkinson, floyd_steinberg."""
    if mode == "direct":
        found = palette.nearest(images)
    elif mode == "ordered":
        two = np.array([[0, 2], [3, 1]])
        found = palette.nearest(shifted(boosted(images, 1.8), (np.tile(4 * two, (2, 2)) + np.repeat(np.repeat(two, 2, 0), 2, 1) - 7.5) * 6))
    elif mode == "blue_noise":
        found = palette.nearest(shifted(boosted(images, 1.4), (spread_thresholds() / 255 - 0.5) * 18))
    elif mode == "atkinson":
        found = diffused(boosted(images, 1.8), palette, ATKINSON, False)
    elif mode == "floyd_steinberg":
        found = diffused(boosted(images, 1.4), palette, FLOYD_STEINBERG, True)
    else:
        raise ValueError(f"unknown mode {mode}")
    return palette.places[found].astype(np.uint8)


def quantised(pictures: DataFrame, mode: str = "floyd_steinberg", colours: tuple[tuple[int, int, int] | None, ...] = SIX_COLOURS) -> DataFrame:
    """(id, width, height, places, packed): every pixel's place in the palette, as a byte each and two to a byte.

    ``mode`` as for ``in_colours``; in ``packed`` the first of two pixels is in the upper half, and a last one alone has a zero beside it.
    """
    def work(images: np.ndarray) -> dict[str, np.ndarray | list]:
        n, h, w = images.shape[:3]
        flat = in_colours(images, Palette(colours), mode).reshape(n, h * w)
        even = np.pad(flat, ((0, 0), (0, h * w % 2)))
        packed = (even[:, ::2] << 4) | (even[:, 1::2] & 0x0F)
        return {"w": np.full(n, w, np.int32), "h": np.full(n, h, np.int32), "places": [x.tobytes() for x in flat], "packed": [x.tobytes() for x in packed]}

    return stacks(pictures, work, "width int, height int, places binary, packed binary")
