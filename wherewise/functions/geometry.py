"""Geometry of upright boxes as column expressions.

A box has a centre (cx, cy, cz), half sizes (hx, hy, hz) and a horizontal unit axis (ux, uy); its other horizontal axis is
(-uy, ux), and z is up. Everything here is a Catalyst expression, so it runs inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-9


def ramp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """0 up to lo, 1 from hi on, linear between; a step where hi <= lo."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(hi <= lo, F.when(x >= hi, 1.0).otherwise(0.0)).otherwise(clip((x - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def gmean(values: list[Column], weights: list[float] | list[Column]) -> Column:
    """Weighted geometric mean of values clipped to [1e-6, 1]."""
    number = lambda w: w if isinstance(w, Column) else float(w)
    total = sum((F.log(clip(v, 1e-6)) * number(w) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    return F.exp(total / number(sum(weights)))


def r9(x: Column) -> Column:
    """Rounded as results are, without a negative zero."""
    return F.round(x, 9) + 0.0


@dataclass(frozen=True)
class Span:
    """An interval of numbers."""

    lo: Column
    hi: Column

    @property
    def length(self) -> Column:
        return F.greatest(F.lit(0.0), self.hi - self.lo)

    @property
    def mid(self) -> Column:
        return (self.lo + self.hi) * 0.5

    def overlap(self, o: Span) -> Column:
        return F.greatest(F.lit(0.0), F.least(self.hi, o.hi) - F.greatest(self.lo, o.lo))

    def iou(self, o: Span) -> Column:
        union = F.greatest(self.hi, o.hi) - F.least(self.lo, o.lo)
        return F.when(union > TINY, self.overlap(o) / union).otherwise(1.0)

    def inside(self, o: Span) -> Column:
        """Share of this span that lies in the other."""
        point = F.when((o.lo - TINY <= self.lo) & (self.lo <= o.hi + TINY), 1.0).otherwise(0.0)
        return F.when(self.length < TINY, point).otherwise(self.overlap(o) / F.when(self.length < TINY, 1.0).otherwise(self.length))

    def gap(self, o: Span) -> Column:
        """Signed: positive where the two are apart."""
        return F.greatest(o.lo - self.hi, self.lo - o.hi, -self.overlap(o))

    def beyond(self, bound: Column, sign: int) -> Column:
        """Share of this span above (sign 1) or below (-1) a bound."""
        part = self.hi - F.greatest(self.lo, bound) if sign > 0 else F.least(self.hi, bound) - self.lo
        point = F.when((self.lo - bound) * sign > 0, 1.0).otherwise(0.0)
        return F.when(self.length < TINY, point).otherwise(F.greatest(F.lit(0.0), part) / F.when(self.length < TINY, 1.0).otherwise(self.length))


@dataclass(frozen=True)
class Box:
    """The box whose columns start with a prefix."""

    prefix: str

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return F.col(f"{self.prefix}_{name}")

    @property
    def bottom(self) -> Column:
        return self.cz - self.hz

    @property
    def top(self) -> Column:
        return self.cz + self.hz

    @property
    def height(self) -> Column:
        return self.hz * 2.0

    @property
    def volume(self) -> Column:
        return self.hx * self.hy * self.hz * 8.0

    @property
    def footprint(self) -> Column:
        return self.hx * self.hy * 4.0

    @property
    def reach(self) -> Column:
        """Horizontal radius."""
        return F.sqrt(self.hx * self.hx + self.hy * self.hy)

    @property
    def tall(self) -> Span:
        return Span(self.bottom, self.top)

    def radius(self, ax: Column, ay: Column) -> Column:
        """Half of the box's extent along a horizontal axis."""
        return self.hx * F.abs(self.ux * ax + self.uy * ay) + self.hy * F.abs(self.ux * ay - self.uy * ax)

    def span(self, ax: Column, ay: Column) -> Span:
        middle, r = self.cx * ax + self.cy * ay, self.radius(ax, ay)
        return Span(middle - r, middle + r)


def overlap_share(a: Box, b: Box) -> Column:
    """Least share of a's extent that lies in b's, over b's two horizontal axes."""
    return F.least(a.span(b.ux, b.uy).inside(b.span(b.ux, b.uy)), a.span(-b.uy, b.ux).inside(b.span(-b.uy, b.ux)), F.lit(1.0))


def box_gap(a: Box, b: Box) -> Column:
    """Largest signed gap over separating axes; upright boxes have five that differ."""
    axes = [(a.ux, a.uy), (-a.uy, a.ux), (b.ux, b.uy), (-b.uy, b.ux)]
    return F.greatest(*[a.span(x, y).gap(b.span(x, y)) for x, y in axes], a.tall.gap(b.tall))


def corners(p: Box) -> list[tuple[Column, Column, Column]]:
    return [(p.cx + p.ux * p.hx * i - p.uy * p.hy * j, p.cy + p.uy * p.hx * i + p.ux * p.hy * j, p.cz + p.hz * k) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)]


def contains(b: Box, x: Column, y: Column, z: Column, pad: float = 0.0) -> Column:
    dx, dy = x - b.cx, y - b.cy
    return (F.abs(dx * b.ux + dy * b.uy) <= b.hx + pad) & (F.abs(dy * b.ux - dx * b.uy) <= b.hy + pad) & (F.abs(z - b.cz) <= b.hz + pad)


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns with a prefix, but for those to keep as they are."""
    return df.select(*[F.col(c).alias(c if c in keep else f"{prefix}_{c}") for c in df.columns])


def horizontal(x: Column, y: Column) -> tuple[Column, Column]:
    """Unit vector in the plane; zero where it is shorter than 1e-6."""
    n = F.sqrt(x * x + y * y)
    safe = F.when(n < 1e-6, 1.0).otherwise(n)
    return F.when(n < 1e-6, 0.0).otherwise(x / safe), F.when(n < 1e-6, 0.0).otherwise(y / safe)
