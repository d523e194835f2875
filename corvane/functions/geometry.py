"""Box algebra and numeric plans as column expressions; boxes are four numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a union before it divides, as the compared results have it.
EPSILON = 1e-6

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> Box:
    """The four columns of a box, their names led by ``prefix``."""
    return tuple(F.col(f"{prefix}{n}") for n in names)


def corners(centre: Box) -> Box:
    """Corners of a (centre x, centre y, width, height) box."""
    x, y, w, h = centre
    return x - w * 0.5, y - h * 0.5, x + w * 0.5, y + h * 0.5


def centred(b: Box) -> Box:
    """Centre and size of a corner box."""
    x1, y1, x2, y2 = b
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def sized(b: Box) -> Box:
    """Least corner and size of a corner box."""
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def unsized(b: Box) -> Box:
    """Corners of a least-corner-and-size box."""
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def area(b: Box) -> Column:
    """The area of a corner box."""
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap_area(a: Box, b: Box) -> Column:
    """The area that two boxes share."""
    side = lambda k: F.greatest(F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]), F.lit(0.0))
    return side(0) * side(1)


def iou(a: Box, b: Box) -> Column:
    """Shared area over united area."""
    shared = overlap_area(a, b)
    return shared / (area(a) + area(b) - shared + EPSILON)


def giou(a: Box, b: Box) -> Column:
    """IoU less the share of the common hull that neither box fills."""
    shared = overlap_area(a, b)
    union = area(a) + area(b) - shared
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return shared / (union + EPSILON) - (hull - union) / (hull + EPSILON)


def touching(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """Whether closed intervals meet on every axis."""
    out = F.lit(True)
    for (a1, a2), (b1, b2) in zip(a, b, strict=True):
        out = out & (a1 <= b2) & (b1 <= a2)
    return out


def clipped(b: Box, width: Column, height: Column) -> Box:
    """A box cut to an image."""
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    return cut(b[0], width), cut(b[1], height), cut(b[2], width), cut(b[3], height)


def cropped(b: Box, x: Column, y: Column, width: Column, height: Column) -> tuple[Box, Column]:
    """A box in the frame of a crop, and whether anything of it is left there."""
    inner = clipped((b[0] - x, b[1] - y, b[2] - x, b[3] - y), width, height)
    return inner, (inner[2] > inner[0]) & (inner[3] > inner[1])


def scaled(b: Box, width: Column, height: Column) -> Box:
    """Centre-size box as shares of an image."""
    x, y, w, h = centred(b)
    return x / width, y / height, w / width, h / height


def half_even(x: Column) -> Column:
    """The nearest integer, halves to the even one."""
    return F.rint(x)


def lifted(b: Box) -> list[Column]:
    """A flat box as depth, height, width corners of one slice."""
    return [F.lit(0), b[1], b[0], F.lit(1), b[3], b[2]]


def nearest_multiple(x: Column, step: int = 4, most: int = 64) -> Column:
    """The multiple of ``step`` up to ``most`` nearest to x; the smaller of two."""
    return F.array_min(F.transform(F.sequence(F.lit(step), F.lit(most), F.lit(step)), lambda d: F.struct(F.abs(d - x).alias("gap"), d.alias("d"))))["d"]


def window_starts(length: Column, crop: int) -> Column:
    """First places of half-overlapping windows of ``crop`` over an axis; the last is moved back inside, one at least."""
    half = crop // 2
    n = F.greatest(F.ceil(length / float(half)) - 1, F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.least(i * half, length - crop), F.lit(0)))


def fitting_side(budget: Column, aspect: Column) -> Column:
    """The largest t with t * ceil(aspect * t) <= budget, by bisection over the bits."""
    def bit(t: Column, b: Column) -> Column:
        wider = t + b
        return F.when(wider * F.ceil(aspect * wider) <= budget, wider).otherwise(t)

    steps = F.array(*(F.lit(1 << k).cast("long") for k in range(15, -1, -1)))
    return F.aggregate(steps, F.lit(0).cast("long"), bit)


def depth_patch(depth: Column, pool: int, most_depth: int, most_bits: int) -> Column:
    """The power of two that brings a depth near ``most_depth`` pooled slices."""
    bits = F.least(F.greatest(F.rint(F.log2(depth / float(pool * most_depth))), F.lit(0.0)), F.lit(float(most_bits)))
    return F.pow(F.lit(2.0), bits).cast("int")


def resized(shape: list[Column], most: int) -> list[Column]:
    """A shape scaled so that its longest edge is at most ``most``, edges at least 1."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(*shape)) if len(shape) > 1 else F.least(F.lit(1.0), F.lit(float(most)) / shape[0])
    return [F.greatest(F.rint(s * ratio), F.lit(1.0)).cast("int") for s in shape]


def patch_start(centre: Column, patch: Column, size: Column) -> Column:
    """Where a patch round a centre starts, kept inside the axis."""
    return F.greatest(F.least(F.floor(centre - patch / 2), size - patch), F.lit(0)).cast("int")


def inverse_sigmoid(x: Column, eps: float = 1e-3) -> Column:
    """log(x / (1 - x)) with both clamped from below."""
    c = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.log(F.greatest(c, F.lit(eps)) / F.greatest(1 - c, F.lit(eps)))


def hounsfield(value: Column, slope: Column, intercept: Column, low: float = -500.0, high: float = 1000.0) -> Column:
    """A stored CT value in Hounsfield units, clipped to a window."""
    return F.least(F.greatest(value * slope + intercept, F.lit(low)), F.lit(high))


def affine(orientation: list[Column], position: list[Column], spacing: list[Column]) -> list[list[Column]]:
    """Rows of the 4 x 4 affine of a slice stack: two direction triples, their cross product, and the translation in the last column."""
    a, b = orientation[:3], orientation[3:]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return [[a[k] * spacing[0], b[k] * spacing[1], c[k] * spacing[2], position[k]] for k in range(3)] + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


def focal_cost(p: Column, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-8) -> Column:
    """Class cost of a probability: the focal loss of a hit less that of a miss."""
    hit = alpha * F.pow(1 - p, F.lit(gamma)) * -F.log(p + eps)
    miss = (1 - alpha) * F.pow(p, F.lit(gamma)) * -F.log(1 - p + eps)
    return hit - miss


def match_cost(class_cost: Column, a: Box, b: Box, w_class: float = 1.0, w_l1: float = 1.0, w_giou: float = 1.0) -> Column:
    """Weighted class cost, L1 distance of boxes, and negative GIoU."""
    l1 = sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    return w_class * class_cost + w_l1 * l1 - w_giou * giou(a, b)
