"""Functions of one input, as colour spaces use them: exponential, stitched and sampled ones, as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponential(t: Column, c0: Sequence[float] = (0.0,), c1: Sequence[float] = (1.0,), n: float = 1.0) -> list[Column]:
    """Values between ``c0`` and ``c1`` at t to the power of n; missing ones count as 0 and 1."""
    size = max(len(c0), len(c1))
    ends = [(c0[i] if i < len(c0) else 0.0, c1[i] if i < len(c1) else 1.0) for i in range(size)]
    return [F.lit(a) + F.pow(t, F.lit(n)) * (b - a) for a, b in ends]


def stitched(t: Column, parts: Sequence[Callable[[Column], Column]], bounds: Sequence[float], encode: Sequence[float], domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """The part in whose interval t lies, with t carried over to that part's own range; t is kept within the domain."""
    low, high = min(domain), max(domain)
    t = F.least(F.greatest(t, F.lit(low)), F.lit(high))
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for i in reversed(range(len(parts))):
        a, b = edges[i], edges[i + 1]
        e0, e1 = encode[2 * i : 2 * i + 2] if len(encode) > 2 * i + 1 else (0.0, 1.0)
        value = parts[i](F.lit(e0) + (t - a) / (b - a) * (e1 - e0) if b > a else F.lit(e0))
        out = value if out is None else F.when(t < edges[i + 1], value).otherwise(out)
    return out


def sampled(t: Column, samples: Sequence[float], domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Samples at equal steps over the domain, with straight lines between them."""
    steps = len(samples) - 1
    at = F.least(F.greatest((t - domain[0]) / (domain[1] - domain[0]) * steps, F.lit(0.0)), F.lit(float(steps)))
    low = F.least(F.floor(at).cast("int"), F.lit(max(steps - 1, 0)))
    held = F.array(*map(F.lit, samples))
    return F.get(held, low) + (at - low) * (F.coalesce(F.get(held, low + 1), F.get(held, low)) - F.get(held, low))
