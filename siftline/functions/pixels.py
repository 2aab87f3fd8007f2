"""Pixel transforms as expressions over flat channel-major arrays of numbers in [0, 1].

An image is one ``array<double>`` of c * h * w values. Moves (flips, rotations, permutations) are
one gather by index arithmetic; photometric changes are one pass over the array. Randomness is a
seeded hash of the row's key, so a row gets the same change in any run and any partition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.scalars import hashed_bits, let


def uniform(seed: int, *key: Column) -> Column:
    """Seeded number in [0, 1) of a row's key, by SHA-256, so that SQL of any engine draws the same."""
    return hashed_bits(seed, *key) / F.lit(float(2**52))


def pixel_uniform(seed: int, *key: Column) -> Column:
    """Seeded number in [0, 1) for draws of every pixel, by the faster XXH64."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / F.lit(float(2**53))


def between(seed: int, low: float, high: float, *key: Column) -> Column:
    return low + uniform(seed, *key) * (high - low)


def gather(img: Column, size: int, index: Callable[[Column], Column]) -> Column:
    """Value at ``index(i)`` for every place i."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.element_at(img, (index(i) + 1).cast("int")))


def _parts(i: Column, h: int, w: int) -> tuple[Column, Column, Column]:
    """Channel, row and column of a flat place."""
    return F.floor(i / (h * w)), F.floor(i / w) % h, i % w


def flip_columns(img: Column, c: int, h: int, w: int) -> Column:
    return gather(img, c * h * w, lambda i: i - 2 * (i % w) + w - 1)


def flip_rows(img: Column, c: int, h: int, w: int) -> Column:
    def at(i):
        ch, y, x = _parts(i, h, w)
        return ch * (h * w) + (h - 1 - y) * w + x

    return gather(img, c * h * w, at)


def rotate_quarter(img: Column, c: int, h: int, w: int, turns: int) -> Column:
    """Counter-clockwise quarter turns of a square image."""
    if h != w and turns % 2:
        raise ValueError("odd quarter turns need a square image")

    def at(i):
        ch, y, x = _parts(i, h, w)
        sy, sx = {0: (y, x), 1: (x, w - 1 - y), 2: (h - 1 - y, w - 1 - x), 3: (h - 1 - x, y)}[turns % 4]
        return ch * (h * w) + sy * w + sx

    return gather(img, c * h * w, at)


#: Orders of three channels, and of the four quarters of an image, by label.
CHANNEL_ORDERS = tuple(permutations(range(3)))
QUARTER_ORDERS = tuple(permutations(range(4)))


def permute_channels(img: Column, h: int, w: int, order: tuple[int, ...]) -> Column:
    return F.concat(*(F.slice(img, k * h * w + 1, h * w) for k in order))


def shuffle_quarters(img: Column, c: int, h: int, w: int, order: tuple[int, ...]) -> Column:
    """The 2 by 2 blocks of an image of even sides in another order."""
    hh, hw = h // 2, w // 2
    source = F.array(*map(F.lit, order))

    def at(i):
        ch, y, x = _parts(i, h, w)
        b = F.element_at(source, (F.floor(y / hh) * 2 + F.floor(x / hw) + 1).cast("int"))
        return ch * (h * w) + (F.floor(b / 2) * hh + y % hh) * w + (b % 2) * hw + x % hw

    return gather(img, c * h * w, at)


def brightness(img: Column, factor: Column | float) -> Column:
    return F.transform(img, lambda v: v * factor)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def contrast(img: Column, c: int, h: int, w: int, factor: Column | float) -> Column:
    """Each channel around its own mean."""
    planes = [F.slice(img, k * h * w + 1, h * w) for k in range(c)]

    def around_mean(p):
        return let(_mean(p), lambda m: F.transform(p, lambda v: (v - m) * factor + m))

    return F.concat(*map(around_mean, planes))


def _planes(img: Column, h: int, w: int) -> list[Column]:
    return [F.slice(img, k * h * w + 1, h * w) for k in range(3)]


def _mix(img: Column, h: int, w: int, rows: list[tuple]) -> Column:
    """Each output channel as a linear mix of the three, by row of weights."""
    r, g, b = _planes(img, h, w)
    rgb = F.zip_with(F.zip_with(r, g, lambda x, y: F.struct(x.alias("r"), y.alias("g"))), b, lambda p, z: F.struct(p["r"].alias("r"), p["g"].alias("g"), z.alias("b")))

    def channel(m):
        return F.transform(rgb, lambda p: p["r"] * m[0] + p["g"] * m[1] + p["b"] * m[2])

    return F.concat(*map(channel, rows))


def saturation(img: Column, h: int, w: int, factor: Column | float) -> Column:
    """Around the mean of the three channels."""
    grey = (1 - factor) / 3
    return _mix(img, h, w, [tuple(grey + factor if i == j else grey for j in range(3)) for i in range(3)])


def grayscale(img: Column, h: int, w: int) -> Column:
    # Luminance weights.
    return _mix(img, h, w, [(0.299, 0.587, 0.114)] * 3)


def hue(img: Column, h: int, w: int, shift: Column | float) -> Column:
    """Channel mixing by the cosine and sine of a shift."""
    angle = (shift if isinstance(shift, Column) else F.lit(float(shift))) * 3.14159 * 2
    c, s = F.cos(angle), F.sin(angle)
    # Constant, cosine and sine parts of the mixing matrix, row by row.
    parts = (
        ((0.299, 0.701, 0.168), (0.587, -0.587, 0.330), (0.114, -0.114, -0.497)),
        ((0.299, -0.299, -0.328), (0.587, 0.413, 0.035), (0.114, -0.114, 0.292)),
        ((0.299, -0.300, 1.250), (0.587, -0.588, -1.050), (0.114, 0.886, -0.203)),
    )
    return _mix(img, h, w, [tuple(F.lit(a) + c * b + s * d for a, b, d in row) for row in parts])


def solarize(img: Column, threshold: float = 0.5) -> Column:
    return F.transform(img, lambda v: F.when(v > threshold, 1 - v).otherwise(v))


#: Thresholds of the four solarisation labels; label 0 changes nothing.
SOLARIZE_LEVELS = (None, 0.75, 0.5, 0.25)


def posterize(img: Column, bits: int = 4) -> Column:
    return F.transform(img, lambda v: F.floor(v * 2**bits) / 2**bits)


def equalize(img: Column, c: int, h: int, w: int) -> Column:
    """Histogram equalisation by channel over 256 levels; a channel of one level stays as it is.

    A pixel's new value is the share of the other levels' pixels at or below its level.
    """
    def plane(p):
        levels = F.transform(p, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 255).cast("int"))))

        def remap(s):
            ordered = F.array_sort(s)

            def done(o):
                low = F.size(F.filter(o, lambda x: x == o[0]))
                span = F.size(o) - low
                return F.when(span <= 0, p).otherwise(F.transform(s, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.size(F.filter(o, lambda y: y <= x)) - low) / span))))

            return let(ordered, done)

        return let(levels, remap)

    return F.concat(*(plane(F.slice(img, k * h * w + 1, h * w)) for k in range(c)))


def cutout(img: Column, c: int, h: int, w: int, top: Column | int, left: Column | int, height: int, width: int, fill: float | Column = 0.0) -> Column:
    """A rectangle filled with a value."""
    def at(v, i):
        _, y, x = _parts(i, h, w)
        return F.when((y >= top) & (y < top + height) & (x >= left) & (x < left + width), fill).otherwise(v)

    return F.transform(img, at)


def grid_mask(img: Column, c: int, h: int, w: int, grid: int = 16, ratio: float = 0.5, dy: int = 0, dx: int = 0) -> Column:
    """Zero squares of ratio * grid at every grid step."""
    m = int(grid * ratio)

    def at(v, i):
        _, y, x = _parts(i, h, w)
        return F.when(((y + dy) % grid < m) & ((x + dx) % grid < m), 0.0).otherwise(v)

    return F.transform(img, at)


def noise(img: Column, std: float, seed: int, *key: Column) -> Column:
    """Gaussian noise by the Box-Muller rule from hashed uniforms."""
    def at(v, i):
        u, t = pixel_uniform(seed, *key, i), pixel_uniform(seed + 1, *key, i)
        return v + std * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * t)

    return F.transform(img, at)


def patch_mask(img: Column, c: int, h: int, w: int, patch: int, ratio: float, seed: int, *key: Column) -> Column:
    """Zero floor(ratio * n) of the n square patches, those first by seeded draw."""
    across, n = w // patch, (h // patch) * (w // patch)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.struct(uniform(seed, *key, p).alias("o"), p.alias("p"))))
    gone = F.transform(F.slice(order, F.lit(1), F.lit(int(ratio * n))), lambda x: x["p"])

    def masked(g):
        def at(v, i):
            _, y, x = _parts(i, h, w)
            inside = (y < h // patch * patch) & (x < across * patch)
            return F.when(inside & F.array_contains(g, (F.floor(y / patch) * across + F.floor(x / patch)).cast("int")), 0.0).otherwise(v)

        return F.transform(img, at)

    return let(gone, masked)


def erase(img: Column, c: int, h: int, w: int, seed: int, key: Column, scale=(0.02, 0.33), ratio=(0.3, 3.3)) -> Column:
    """A rectangle of drawn area and aspect at a drawn place, every value of it drawn anew."""
    from math import log

    area = between(seed, *scale, key) * (h * w)
    aspect = F.exp(between(seed + 1, log(ratio[0]), log(ratio[1]), key))
    eh, ew = (F.least(F.greatest(F.rint(F.sqrt(s)).cast("int"), F.lit(1)), F.lit(n)) for s, n in ((area * aspect, h), (area / aspect, w)))
    box = F.struct(eh.alias("h"), ew.alias("w"), F.floor(uniform(seed + 2, key) * (h - eh + 1)).alias("y"), F.floor(uniform(seed + 3, key) * (w - ew + 1)).alias("x"))

    def fill(b):
        def at(v, i):
            _, y, x = _parts(i, h, w)
            return F.when((y >= b["y"]) & (y < b["y"] + b["h"]) & (x >= b["x"]) & (x < b["x"] + b["w"]), pixel_uniform(seed + 4, key, i)).otherwise(v)

        return F.transform(img, at)

    return let(box, fill)


def sometimes(change: Callable[[Column], Column], p: float, seed: int, *key: Column) -> Callable[[Column], Column]:
    """A change applied to a row with probability p."""
    return lambda img: F.when(uniform(seed, *key) < p, change(img)).otherwise(img)


@dataclass
class Pipeline:
    """Changes in order, then a clamp to [0, 1]."""

    steps: list[Callable[[Column], Column]] = field(default_factory=list)

    def __call__(self, img: Column) -> Column:
        """As one expression, each step's input worked out once; without steps that run Python."""
        for step in self.steps:
            img = let(img, step)
        return self._clamp(img)

    def on(self, df: DataFrame, col: str) -> DataFrame:
        """As projections one after the other, which also takes steps that run Python."""
        for step in self.steps:
            df = df.withColumn(col, step(F.col(col)))
        return df.withColumn(col, self._clamp(F.col(col)))

    @staticmethod
    def _clamp(img: Column) -> Column:
        return F.transform(img, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def crop_boxes(seed: int, key: Column, h: int, w: int, scale=(0.2, 1.0), ratio=(3 / 4, 4 / 3)) -> Column:
    """Random resized crop of a row: struct of centre and half sides, all as shares of the image."""
    from math import log

    area = between(seed, *scale, key) * (h * w)
    aspect = F.exp(between(seed + 1, log(ratio[0]), log(ratio[1]), key))
    cw, ch = F.least(F.sqrt(area * aspect), F.lit(float(w))), F.least(F.sqrt(area / aspect), F.lit(float(h)))
    left, top = uniform(seed + 2, key) * (w - cw), uniform(seed + 3, key) * (h - ch)
    return F.struct(((left + cw / 2) / w).alias("cx"), ((top + ch / 2) / h).alias("cy"), (cw / 2 / w).alias("hw"), (ch / 2 / h).alias("hh"))


def coordinate_map(box: Column, h: int, w: int, flip: Column) -> Column:
    """Input place (x, y in [0, 1]) of each pixel of a crop of h by w."""
    def at(i):
        y, x = (F.floor(i / w) + 0.5) / h, (i % w + 0.5) / w
        x = F.when(flip, 1 - x).otherwise(x)
        return F.struct((box["cx"] + (2 * x - 1) * box["hw"]).alias("x"), (box["cy"] + (2 * y - 1) * box["hh"]).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), at)


def resized_sides(h: Column, w: Column, long_side: int = 640) -> Column:
    """Sides after the longer one is brought down to ``long_side``; small images stay, a side is 1 at least."""
    longest = F.greatest(h, w)
    scaled = lambda s: F.greatest(F.lit(1), F.rint(s * long_side / longest).cast("int"))
    return F.when(longest <= long_side, F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"))).otherwise(F.struct(scaled(h).alias("h"), scaled(w).alias("w")))
