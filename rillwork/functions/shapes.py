"""Column expressions of earthwork primitives: quantized parameters, centre lines, cross profiles, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantized(v: Column, step: float) -> Column:
    """v on a grid of `step`, halves away from zero; a step of 0 leaves it."""
    return F.round(v / step) * step if step > 0 else v


def softplus(x: Column) -> Column:
    return F.when(x > 30, x).when(x < -30, F.exp(x)).otherwise(F.log1p(F.exp(F.least(x, F.lit(30.0)))))


def reflected(x: Column) -> Column:
    """x folded back into [0, 1]."""
    y = F.pmod(x, F.lit(2.0))
    return F.when(y > 1, 2 - y).otherwise(y)


def half_axis(length: Column, angle_deg: Column) -> tuple[Column, Column]:
    a = F.radians(angle_deg)
    return F.cos(a) * length / 2, F.sin(a) * length / 2


def distance_to_segment(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    along = F.when(square > 0, ((x - x0) * dx + (y - y0) * dy) / F.when(square > 0, square).otherwise(1.0)).otherwise(0.0)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    px, py = x - x0 - along * dx, y - y0 - along * dy
    return F.sqrt(px * px + py * py)


def profile(distance: Column, width: Column, kind: Column) -> Column:
    """Share of the height at a distance from the centre line: a smooth bump; a cut is flat over half of its width."""
    s = distance / (width / 2)
    flat = F.when(s <= 0.5, 0.0).otherwise((s - 0.5) * 2)
    u = F.when(kind == "cut", flat).otherwise(s)
    return F.when(s >= 1, 0.0).otherwise((1 - u * u) * (1 - u * u))


def sign_of(kind: Column) -> Column:
    return F.when(kind.isin("berm", "mound"), 1.0).otherwise(-1.0)


def bounds(x: Column, y: Column, length: Column, width: Column, angle_deg: Column) -> dict[str, Column]:
    """The box around a primitive: its centre line's ends and half its width beyond."""
    ax, ay = half_axis(length, angle_deg)
    dx, dy = F.abs(ax) + width / 2, F.abs(ay) + width / 2
    return {"x_min": x - dx, "x_max": x + dx, "y_min": y - dy, "y_max": y + dy}


def footprint(x: Column, y: Column, length: Column, width: Column, angle_deg: Column) -> Column:
    """An array of structs (x, y): the stadium around a straight primitive, 17 points around each end."""
    a = F.radians(angle_deg)

    def point(i: Column) -> Column:
        t = -F.pi() / 2 + F.pi() * F.when(i <= 16, i).otherwise(i - 1) / 16
        along = F.when(i <= 16, 1).otherwise(-1) * length / 2 + F.cos(t) * width / 2
        beside = F.sin(t) * width / 2
        return F.struct((x + F.cos(a) * along - F.sin(a) * beside).alias("x"), (y + F.sin(a) * along + F.cos(a) * beside).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(33)), point)
