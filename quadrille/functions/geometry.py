"""Lines and circles as column expressions; where there is no answer it is null."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_squared(x1, y1, x2, y2) -> Column:
    return (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((distance_squared(x1, y1, x2, y2)).cast("double"))


def _whole(c) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


@dataclass(frozen=True)
class Circle:
    x: Column
    y: Column
    r: Column


@dataclass(frozen=True)
class Line:
    """a * x + b * y = c."""

    a: Column
    b: Column
    c: Column

    @classmethod
    def through(cls, x1, y1, x2, y2) -> Line:
        x1, y1, x2, y2 = map(_whole, (x1, y1, x2, y2))
        return cls(y2 - y1, x1 - x2, x1 * y2 - x2 * y1)

    def y_of(self, x) -> Column:
        return F.when(self.b != 0, (self.c - self.a * x) / self.b)

    def x_of(self, y) -> Column:
        return F.when(self.a != 0, (self.c - self.b * y) / self.a)

    def same(self, other: Line, tolerance: float = 0.0) -> Column:
        """Whether both are the same line, whatever their scale."""
        near = lambda p, q: F.abs(p - q) <= tolerance
        return near(self.a * other.b, other.a * self.b) & near(self.a * other.c, other.a * self.c) & near(self.b * other.c, other.b * self.c)

    def meets(self, other: Line) -> tuple[Column, Column]:
        """The point where two lines cross; null for parallels."""
        det = self.a * other.b - other.a * self.b
        return F.when(det != 0, (self.c * other.b - other.c * self.b) / det), F.when(det != 0, (self.a * other.c - other.a * self.c) / det)

    def to_point(self, x, y) -> Column:
        return F.abs(self.a * x + self.b * y - self.c) / F.sqrt(self.a * self.a + self.b * self.b)

    def to_circle(self, circle: Circle) -> Column:
        return F.greatest(self.to_point(circle.x, circle.y) - circle.r, F.lit(0.0))

    def crosses(self, circle: Circle) -> tuple[Column, Column, Column, Column]:
        """Both points of a circle that are on the line; null where it misses."""
        n = self.a * self.a + self.b * self.b
        d = self.c - self.a * circle.x - self.b * circle.y
        rest = circle.r * circle.r * n - d * d
        h = F.when(rest >= 0, F.sqrt(F.greatest(rest, F.lit(0.0))))
        x, y = circle.x + self.a * d / n, circle.y + self.b * d / n
        return x + self.b * h / n, y - self.a * h / n, x - self.b * h / n, y + self.a * h / n


def rotated(x, y, angle) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def arc_radius(x1, y1, x2, y2, angle) -> Column:
    """Radius of an arc of the given angle over a chord."""
    return distance(x1, y1, x2, y2) / 2.0 / F.sin(_whole(angle) / 2.0)


def arc_center(x1, y1, x2, y2, angle, clockwise: bool = True) -> tuple[Column, Column]:
    """Center of the arc, which is on the right of the way from start to end if it is clockwise."""
    rise = 2.0 * F.tan(_whole(angle) / 2.0)
    sign = 1.0 if clockwise else -1.0
    return (x1 + x2) / 2.0 + sign * (y2 - y1) / rise, (y1 + y2) / 2.0 - sign * (x2 - x1) / rise


def arc_angle(radius, chord) -> Column:
    """Angle of an arc with a given chord; null for chords longer than the circle is wide."""
    share = chord / (2.0 * radius)
    return F.when(F.abs(share) <= 1, 2.0 * F.asin(share))


def slope(x1, y1, x2, y2) -> Column:
    """Null for vertical lines."""
    return F.when(x1 != x2, (y1 - y2) / (x1 - x2))


def circle_angle(x, y) -> Column:
    return F.atan2(y, x)


def octant(x, y) -> Column:
    """0 to 7 counterclockwise from the x axis; each closed on its counterclockwise side, the origin in 0."""
    return (
        F.when((x == 0) & (y == 0), 0)
        .when((x >= 0) & (y > 0), F.when(y > x, 1).otherwise(0))
        .when((x < 0) & (y >= 0), F.when(-x > y, 3).otherwise(2))
        .when((x <= 0) & (y < 0), F.when(-y > -x, 5).otherwise(4))
        .otherwise(F.when(x > -y, 7).otherwise(6))
    )


def closest_modulus(base, value, modulus) -> Column:
    """The number equal to value modulo modulus that is closest to base."""
    return value - F.floor((value - base) / modulus + 0.5) * modulus


def sectors(start: int, within_start: float, end: int, within_end: float, count: int, positive: bool) -> list[int]:
    """Sectors of a circle on the way from start to end, both included; within: how far a point is along its sector."""
    step = 1 if positive else -1
    ahead = (end - start) * step % count
    if ahead == 0 and not ((within_start > within_end) if positive else (within_start < within_end)):
        ahead = count
    return [(start + step * k) % count for k in range(ahead + 1)]


THIRD = math.pi / 3
