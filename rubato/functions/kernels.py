"""Filter kernels."""

from __future__ import annotations

import math


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [w / math.fsum(raw) for w in raw]
