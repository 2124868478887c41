"""Column functions: clipping, scales, grids, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_RATE, MAX_RATE = 1.0, 10.0

# The labels of an emission frame in order (the first is blank),
# the labels of each class (any other label is a plosive), and the floors.
LABELS = list("-aienuotsrmkldghybpwcvjzf'qx*")
CLASS_LABELS = {"fricative": "szfvhx", "nasal": "mn", "liquid_glide": "lrwyj", "vowel": "aeiou"}
CLASS_FLOORS = {"plosive": 0.50, "fricative": 0.42, "nasal": 0.35, "liquid_glide": 0.25, "vowel": 0.10, "silence": 0.02}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def importance_to_rate(score: Column) -> Column:
    """The least important frames play ``MAX_RATE`` times as fast."""
    return 1 + (1 - score) * (MAX_RATE - 1)


def rate_contrast(rate: Column, gamma: float) -> Column:
    if gamma == 1.0:
        return rate
    return clip(F.pow((rate - 1) / 9, F.lit(gamma)) * 9 + 1, MIN_RATE, MAX_RATE)


def grid_time(index: Column, n: Column, duration: Column) -> Column:
    """Time of point ``index`` on a grid of ``n`` points, both ends included; 0 if n is 1."""
    return F.when(n > 1, index * duration / (n - 1)).otherwise(F.lit(0.0))


def parse_resolution(text: Column) -> Column:
    """Seconds of "20ms", "1s" or a bare number of milliseconds."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9.]+)", 1).cast("double")
    return F.when(t.endswith("ms"), number / 1000).when(t.endswith("s"), number).otherwise(number / 1000)


def augmentation_ratio(step: Column) -> Column:
    """0.15 up to step 1000, rising to 0.25 at step 3000, flat after."""
    ramp = 0.15 + (step - 1000) / 2000 * 0.10
    return F.when(step < 1000, F.lit(0.15)).when(step < 3000, ramp).otherwise(F.lit(0.25))


def decibels(x: Column) -> Column:
    return 20 * F.log10(x + 1e-10)


def from_decibels(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def from_polar(log_magnitude: Column, phase: Column) -> tuple[Column, Column]:
    """Real and imaginary part from the log of a magnitude, 100 at most, and a phase."""
    magnitude = F.least(F.exp(log_magnitude), F.lit(100.0))
    return magnitude * F.cos(phase), magnitude * F.sin(phase)


def label_class(label: Column) -> Column:
    out = F.lit("plosive")
    for name, labels in CLASS_LABELS.items():
        out = F.when(label.isin(list(labels)), F.lit(name)).otherwise(out)
    return out


def class_floor(name: Column) -> Column:
    out = F.lit(CLASS_FLOORS["silence"])
    for cls, floor in CLASS_FLOORS.items():
        out = F.when(name == cls, F.lit(floor)).otherwise(out)
    return out


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
