"""Box algebra as Column expressions. Boxes are array<double> x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("xyxy", "xywh", "cxcywh")


def at(b: Column, i: int) -> Column:
    return b[i].cast("double")


def width(b: Column) -> Column:
    return at(b, 2) - at(b, 0)


def height(b: Column) -> Column:
    return at(b, 3) - at(b, 1)


def to_xyxy(b: Column, fmt: str) -> Column:
    p, q, r, s = (at(b, i) for i in range(4))
    if fmt == "xyxy":
        return F.array(p, q, r, s)
    if fmt == "xywh":
        return F.array(p, q, p + r, q + s)
    if fmt == "cxcywh":
        return F.array(p - r / 2, q - s / 2, p + r / 2, q + s / 2)
    raise ValueError(f"box format must be one of {FORMATS}, not {fmt!r}")


def longest_side_at_least(b: Column, side: float) -> Column:
    return F.greatest(width(b), height(b)) >= float(side)


def both_sides_at_least(b: Column, side: float) -> Column:
    return (width(b) >= float(side)) & (height(b) >= float(side))


def square_chip(b: Column, min_size: float = 25) -> Column:
    """array<bigint>: the square region of a chip around the box's centre, not clipped to the image."""
    side = F.greatest(width(b), height(b), F.lit(float(min_size)))
    cx, cy = (at(b, 0) + at(b, 2)) / 2, (at(b, 1) + at(b, 3)) / 2
    x, y, n = F.floor(cx - side / 2).cast("long"), F.floor(cy - side / 2).cast("long"), F.ceil(side).cast("long")
    return F.array(x, y, x + n, y + n)


def crop_window(region: Column, image_w: Column, image_h: Column) -> Column:
    """struct: the part of a region that lies in the image (src_*) and where it goes in the zero-padded crop (dst_*)."""
    x1, y1, x2, y2 = (region[i].cast("long") for i in range(4))
    zero = F.lit(0).cast("long")
    sx1, sy1 = F.greatest(x1, zero), F.greatest(y1, zero)
    sx2, sy2 = F.least(x2, image_w.cast("long")), F.least(y2, image_h.cast("long"))
    empty = (sx2 <= sx1) | (sy2 <= sy1)
    pick = lambda c: F.when(empty, zero).otherwise(c)
    return F.struct(
        pick(sx1).alias("src_x1"), pick(sy1).alias("src_y1"), pick(sx2).alias("src_x2"), pick(sy2).alias("src_y2"),
        pick(sx1 - x1).alias("dst_x1"), pick(sy1 - y1).alias("dst_y1"), pick(sx2 - x1).alias("dst_x2"), pick(sy2 - y1).alias("dst_y2"),
    )


def crop_pixels(image, region) -> object:
    """Zero-padded square crop of an (H, W) or (H, W, C) array."""
    import numpy as np

    img = np.asarray(image)
    if img.ndim not in (2, 3):
        raise ValueError("an image has two or three dimensions")
    x1, y1, x2, y2 = (int(v) for v in region)
    out = np.zeros((y2 - y1, x2 - x1, *img.shape[2:]), img.dtype)
    a, b, c, d = max(x1, 0), max(y1, 0), min(x2, img.shape[1]), min(y2, img.shape[0])
    if c > a and d > b:
        out[b - y1 : d - y1, a - x1 : c - x1] = img[b:d, a:c]
    return out


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union isn't positive. Negative areas count as 0."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)), zero)
    h = F.greatest(F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)), zero)
    inter = w * h
    area = lambda c: F.greatest(width(c), zero) * F.greatest(height(c), zero)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def is_valid(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & (width(b) > 0) & (height(b) > 0), F.lit(False))


def checked(b: Column) -> Column:
    """The box, or an error at run time if it isn't four values with positive sides."""
    return F.when(is_valid(b), b).otherwise(F.raise_error(F.lit("a box must have four values and positive sides")))


def to_relative_xywh(b: Column, image_w: Column, image_h: Column) -> Column:
    return F.array(at(b, 0) / image_w, at(b, 1) / image_h, width(b) / image_w, height(b) / image_h)


def l1_distance(a: Column, b: Column) -> Column:
    return F.abs(at(a, 0) - at(b, 0)) + F.abs(at(a, 1) - at(b, 1)) + F.abs(at(a, 2) - at(b, 2)) + F.abs(at(a, 3) - at(b, 3))


def sql_iou(a: str, b: str) -> str:
    """DuckDB form of ``iou``."""
    inter = f"(greatest(least({a}[3], {b}[3]) - greatest({a}[1], {b}[1]), 0.0::DOUBLE) * greatest(least({a}[4], {b}[4]) - greatest({a}[2], {b}[2]), 0.0::DOUBLE))"
    area = lambda c: f"(greatest({c}[3] - {c}[1], 0.0::DOUBLE) * greatest({c}[4] - {c}[2], 0.0::DOUBLE))"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0::DOUBLE END"
