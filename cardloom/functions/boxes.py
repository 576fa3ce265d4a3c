"""Boxes on an image (``left``, ``top``, ``right``, ``bottom`` in pixels) and confidences, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def _clamp(x: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(x, F.lit(least)), F.lit(most))


def _area(a: Column) -> Column:
    return (a["right"] - a["left"]) * (a["bottom"] - a["top"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """The part of the smaller box that lies in both; 0 where they are apart or it is empty."""
    wide = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    high = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    smaller = F.least(_area(a), _area(b))
    return F.when((wide > 0) & (high > 0) & (smaller != 0), wide * high / smaller).otherwise(F.lit(0.0))


def expand_box(a: Column, width: Column, height: Column) -> Column:
    """The box with 8 % of its width and 16 % of its height more on each side, 8 pixels at least, within the image."""
    pad = lambda size, part: F.greatest(F.lit(8), (size * F.lit(part)).cast("int"))
    x, y = pad(a["right"] - a["left"], 0.08), pad(a["bottom"] - a["top"], 0.16)
    return box(
        F.greatest(F.lit(0), a["left"] - x), F.greatest(F.lit(0), a["top"] - y),
        F.least(width, a["right"] + x), F.least(height, a["bottom"] + y))


def absolute_box(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Pixels of a box given in parts of the image, one pixel wide and high at least."""
    left = F.greatest(F.lit(0), F.least(width - 1, (width * x).cast("int")))
    top = F.greatest(F.lit(0), F.least(height - 1, (height * y).cast("int")))
    right = F.greatest(left + 1, F.least(width, (width * (x + w)).cast("int")))
    return box(left, top, right, F.greatest(top + 1, F.least(height, (height * (y + h)).cast("int"))))


def fraction(confidence: Column) -> Column:
    """A confidence in 0 to 1; over 1 it is taken as percent. Null stays null."""
    return F.when(confidence.isNotNull(), _clamp(F.when(confidence > 1, confidence / 100).otherwise(confidence), 0.0, 1.0))


def candidate_confidence(provider: Column, score: Column, source: Column) -> Column:
    """Confidence of a candidate by its provider's and its search score; of one trusted source (a fixed value) its own
    where the score is 180 or more."""
    found = _clamp(score / 420, 0.1, 0.85)
    mixed = _clamp(provider * F.lit(0.55) + found * F.lit(0.45), 0.1, 0.99)
    return F.when((source == "gibltcg") & (score >= 180), _clamp(provider, 0.8, 0.99)).otherwise(mixed)
