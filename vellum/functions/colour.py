"""Colours as columns: process inks to screen, Lab, tables of indexed colours, and sampled functions of any number of inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# What each ink, and each pair of inks, adds to red, green and blue; white points; matrices of colour spaces.
PROCESS = {
    "c": (-1.0, -0.3176470588, -0.0627450980), "m": (-0.0745098039, -1.0, -0.4509803922), "y": (0.0, -0.0509803922, -1.0), "k": (-0.8627450980, -0.8784313725, -0.8745098039),
    "cm": (0.20, 0.0, 0.08), "cy": (0.20, 0.15, 0.465), "ck": (0.15, 0.10, 0.0), "my": (0.0, 0.25, 0.65), "mk": (0.0, 0.15, 0.20), "yk": (0.0, 0.0, 0.40),
}
D50, D65 = (0.96422, 1.0, 0.82521), (0.95047, 1.0, 1.08883)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def _unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def process_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Inks as a screen shows them: sums over inks and pairs of inks, kept between 0 and 1."""
    ink = {n: _unit(x) for n, x in zip("cmyk", (c, m, y, k), strict=True)}
    terms = {names: reduce(lambda a, b: a * b, [ink[n] for n in names]) for names in PROCESS}
    return [_unit(reduce(lambda a, b: a + b, [F.lit(1.0), *[terms[n] * w[i] for n, w in PROCESS.items() if w[i]]])) for i in range(3)]


def plain_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Inks by the plain formula: 1 less the ink and black, 0 at least."""
    return [1 - F.least(F.lit(1.0), _unit(x) + _unit(k)) for x in (c, m, y)]


def _gamma(x: Column) -> Column:
    x = _unit(x)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def lab_rgb(lightness: Column, a: Column, b: Column, white: Sequence[float] = D50) -> list[Column]:
    """Lab to red, green and blue: adapted from its white point to that of screens (both steps are one matrix)."""
    cone = np.array(BRADFORD)
    adapt = np.linalg.inv(cone) @ np.diag((cone @ D65) / (cone @ np.array(white))) @ cone if max(abs(p - q) for p, q in zip(white, D65, strict=True)) > 1e-6 else np.eye(3)
    matrix = np.array(TO_RGB) @ adapt
    y = (lightness + 16) / 116
    back = lambda t: F.when(t > 0.206897, t * t * t).otherwise((t - 16 / 116) / 7.787)
    xyz = [back(t) * w for t, w in zip((a / 500 + y, y, y - b / 200), white, strict=True)]
    return [_gamma(sum((v * float(w) for v, w in zip(xyz, row, strict=True)), F.lit(0.0))) for row in matrix]


def indexed(index: Column, table: Sequence[Sequence[float]]) -> list[Column]:
    """The colours of a table; an index beyond it is its nearest end, halves go to the even one."""
    at = F.least(F.greatest(F.rint(index).cast("int"), F.lit(0)), F.lit(len(table) - 1))
    return [F.get(F.array(*[F.lit(float(row[i])) for row in table]), at) for i in range(len(table[0]))]


def sampled(inputs: Sequence[Column], sizes: Sequence[int], samples: Sequence[Sequence[float]], domain: Sequence[tuple[float, float]] | None = None, encode: Sequence[tuple[float, float]] | None = None, decode: Sequence[tuple[float, float]] | None = None) -> list[Column]:
    """A sampled function of several inputs: samples on a grid (the first input varies fastest), linear between them along every axis.

    ``samples`` are rows of outputs between 0 and 1, which ``decode`` carries to their ranges.  An output is a sum over the corners of a cell, each with the
    product of its distances; the samples of an output are one array in the plan, so tables stay as small as a colour space's are.
    """
    total = reduce(lambda a, b: a * b, sizes)
    if len(samples) != total:
        raise ValueError(f"{total} samples are needed")
    low, share = [], []
    for i, (x, n) in enumerate(zip(inputs, sizes, strict=True)):
        d0, d1 = (domain or [(0.0, 1.0)] * len(sizes))[i]
        e0, e1 = (encode or [(0.0, float(s - 1)) for s in sizes])[i]
        kept = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(d0)), F.lit(d1)))
        at = F.lit(e0) + (kept - d0) * ((e1 - e0) / (d1 - d0) if d1 > d0 else 0.0)
        at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(n - 1)))
        first = F.least(F.floor(at).cast("int"), F.lit(max(n - 2, 0)))
        low.append(first)
        share.append(at - first)
    strides = [reduce(lambda a, b: a * b, sizes[:i], 1) for i in range(len(sizes))]
    out = []
    for o in range(len(samples[0])):
        held = F.array(*[F.lit(float(s[o])) for s in samples])
        value = F.lit(0.0)
        for corner in product((0, 1), repeat=len(sizes)):
            if any(k and n == 1 for k, n in zip(corner, sizes, strict=True)):
                continue
            weight = reduce(lambda a, b: a * b, [s if k else 1 - s for s, k in zip(share, corner, strict=True)])
            place = reduce(lambda a, b: a + b, [(f + k) * step for f, k, step in zip(low, corner, strides, strict=True)])
            value = value + weight * F.get(held, place.cast("int"))
        r0, r1 = (decode or [(0.0, 1.0)] * len(samples[0]))[o]
        out.append(value * (r1 - r0) + r0)
    return out
