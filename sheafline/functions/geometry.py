"""Rectangles as column expressions. A rectangle is four columns with a common prefix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.schema import LayoutSettings, Page


@dataclass(frozen=True)
class Rect:
    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "", source: str = "") -> Rect:
        dot = f"{source}." if source else ""
        return cls(*(F.col(f"{dot}{prefix}{x}") for x in ("left", "top", "right", "bottom")))

    @classmethod
    def in_struct(cls, x: Column, prefix: str = "rel_") -> Rect:
        """Of left, top, width and height with a prefix."""
        left, top = x[f"{prefix}left"], x[f"{prefix}top"]
        return cls(left, top, left + x[f"{prefix}width"], top + x[f"{prefix}height"])

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    def contains(self, other: Rect, tolerance: float = 1.0) -> Column:
        return (self.left - tolerance <= other.left) & (self.right + tolerance >= other.right) & (self.top - tolerance <= other.top) & (self.bottom + tolerance >= other.bottom)

    def intersects(self, other: Rect) -> Column:
        """With an area in common."""
        return (F.greatest(self.left, other.left) < F.least(self.right, other.right)) & (F.greatest(self.top, other.top) < F.least(self.bottom, other.bottom))

    def touches(self, other: Rect, epsilon: float = 0.0) -> Column:
        """Edges count."""
        return (self.left <= other.right + epsilon) & (self.right >= other.left - epsilon) & (self.top <= other.bottom + epsilon) & (self.bottom >= other.top - epsilon)

    def common_area(self, other: Rect) -> Column:
        zero = F.lit(0.0)
        return F.greatest(zero, F.least(self.right, other.right) - F.greatest(self.left, other.left)) * F.greatest(zero, F.least(self.bottom, other.bottom) - F.greatest(self.top, other.top))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def relative(r: Rect, page: Page) -> dict[str, Column]:
    w, h = page.right - page.left, page.bottom - page.top
    return {"rel_left": (r.left - page.left) / w, "rel_top": (r.top - page.top) / h, "rel_width": r.width / w, "rel_height": r.height / h}


def absolute(page: Page, left: Column, top: Column, width: Column, height: Column) -> dict[str, Column]:
    w, h = page.right - page.left, page.bottom - page.top
    return {"abs_left": left * w + page.left, "abs_top": top * h + page.top, "abs_width": width * w, "abs_height": height * h}


def inside_page(left: Column, top: Column, width: Column, height: Column, page: Page) -> tuple[Column, Column]:
    """Left and top, moved so that the box lies in the page as far as it fits."""
    return F.greatest(F.lit(page.left), F.least(left, page.right - width)), F.greatest(F.lit(page.top), F.least(top, page.bottom - height))


def is_proper(*values: Column) -> Column:
    """Are all numbers finite, and the last two (width, height) positive."""
    ok = F.lit(True)
    for v in values:
        ok &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok & (values[-2] > 0) & (values[-1] > 0)


def is_selection(width: Column, height: Column, least: float = 5.0) -> Column:
    """Is a drawn box more than a click."""
    return (width > least) & (height > least)


def font_in_overlay(sizes: Column, scale: float, zoom: float) -> Column:
    """Mean of the sizes (12 where there is none) times scale and zoom."""
    mean = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes)
    return F.when(F.size(sizes) > 0, mean).otherwise(F.lit(12.0)) * scale * zoom


def line_height_choice(value: Column) -> Column:
    return F.floor(clamp(value, 0.8, 2.0) * 10 + 0.5) / 10


def styles_match(a: dict[str, Column], b: dict[str, Column], s: LayoutSettings) -> Column:
    """May spans of these two styles share a paragraph (family, size, weight, style, and color or its rgb). Colours that are the same text need no numbers."""
    if s.linear:
        return F.lit(True)

    def close(x: Column, y: Column) -> Column:
        return F.sqrt(sum(((x[k] - y[k]) * (x[k] - y[k])).cast("double") for k in range(3))) < 10

    # Read by a function of arrays: written out, the colours' patterns would make the window's code too long for the JVM to compile.
    read = F.exists(F.array(F.struct(a["color"].alias("a"), b["color"].alias("b"))), lambda x: close(T.rgb(x["a"]), T.rgb(x["b"]))) if "color" in a else None
    near = close(a["rgb"], b["rgb"]) if "rgb" in a else F.when(a["color"] == b["color"], True).otherwise(read)
    same = (a["family"] == b["family"]) & (F.abs(a["size"] - b["size"]) <= 1.0) & (F.abs(a["weight"] - b["weight"]) <= s.max_weight_difference) & near
    return same if s.mixed_style else same & (a["style"] == b["style"])
