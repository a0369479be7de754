"""Single-page algorithms whose steps depend on the order of earlier steps.

``layout`` feeds them Arrow batches that hold whole pages one after the other. What
can be done for all pages of a batch at once is done in numpy; the merges, which
read what earlier merges made, run page by page on plain lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sheafline.schema import GapSettings, LayoutSettings, Page, SegmentSettings

Strip = tuple[float, float, float, float, float]  # left, right, top, bottom, confidence
Band = tuple[float, float, float]  # y, height, confidence


def spread(values: Sequence[float]) -> float:
    """Standard deviation of a sample; of one value 0."""
    if len(values) < 2:
        return 0.0
    mean = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((x - mean) ** 2 for x in values) / (len(values) - 1))


def median(values: Sequence[float]) -> float:
    ordered, half = sorted(values), len(values) // 2
    return ordered[half] if len(values) % 2 else (ordered[half - 1] + ordered[half]) / 2


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


# --- whole pages ----------------------------------------------------------------------------


@dataclass
class Pages:
    """Rows of whole pages, in reading order, and where each page begins and ends."""

    rows: pa.RecordBatch
    begin: np.ndarray
    end: np.ndarray

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(self.rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def first(self, name: str) -> pa.Array:
        """A column's value at the first row of each page."""
        return self.rows.column(self.rows.schema.get_field_index(name)).take(pa.array(self.begin))

    @property
    def number(self) -> np.ndarray:
        """The page's number, from 0, of each row."""
        return np.repeat(np.arange(len(self.begin)), self.end - self.begin)


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows whose keys differ from those of the row before; nulls are equal to each other."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in keys:
        column = batch.column(batch.schema.get_field_index(name))
        null, values = np.asarray(column.is_null()), column.fill_null(0).to_numpy(zero_copy_only=False)
        new[1:] |= (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def whole_pages(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[Pages]:
    """The batches cut at page ends; rows of a page must follow one another."""
    waiting: list[pa.RecordBatch] = []
    last: tuple | None = None

    def made() -> Pages:
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        begin = _starts(rows, keys)
        return Pages(rows, begin, np.append(begin[1:], rows.num_rows))

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        key = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        cut = int(starts[-1]) if len(starts) > 1 or (waiting and key != last) else None
        if cut is None:
            waiting.append(batch)
        else:
            if cut:
                waiting.append(batch.slice(0, cut))
            yield made()
            waiting = [batch.slice(cut)]
        last = tuple(batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys)
    if waiting:
        yield made()


# --- gaps and strips ------------------------------------------------------------------------


def text_lines(pages: Pages, s: GapSettings) -> np.ndarray:
    """Median height of each page's spans over 3 high."""
    heights = pages.column("height")
    out = np.full(len(pages.begin), s.default_line)
    for k, (a, b) in enumerate(zip(pages.begin.tolist(), pages.end.tolist(), strict=True)):
        own = heights[a:b]
        own = own[own > 3]
        if len(own):
            out[k] = np.median(own)
    return out


def page_gaps(pages: Pages, lines: np.ndarray, page: Page, s: GapSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Empty x-intervals of the pages' bands: page number, band, left, right, in this order."""
    steps = np.maximum(s.band_floor, lines * s.band_lines)
    n_bands = np.ceil((page.bottom - page.top) / steps).astype(np.int64)
    left, top, right, bottom = (pages.column(c).astype(float) for c in ("left", "top", "right", "bottom"))
    number = pages.number
    step, last_band = steps[number], n_bands[number] - 1
    lo = np.clip(np.floor((top - page.top) / step) - 1, 0, None).astype(np.int64)
    hi = np.minimum(np.floor((bottom - page.top) / step) + 1, last_band).astype(np.int64)
    times = np.maximum(hi - lo + 1, 0)
    each = np.repeat(np.arange(len(left)), times)
    band = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    y1 = page.top + band * step[each]
    inside = (bottom[each] > y1) & (top[each] < np.minimum(page.bottom, y1 + step[each]))
    each, band = each[inside], band[inside]
    first_band = np.cumsum(n_bands) - n_bands
    slot = first_band[number[each]] + band  # a number for each band of all pages
    order = np.lexsort((right[each], left[each], slot))
    slot, x1, x2 = slot[order], left[each][order], right[each][order]

    reach, shift = np.maximum(x2, page.left), 1  # largest right edge so far within the band
    while shift < len(slot) and (slot[shift:] == slot[:-shift]).any():
        before = np.where(slot[shift:] == slot[:-shift], reach[:-shift], -np.inf)
        reach[shift:] = np.maximum(reach[shift:], before)
        shift *= 2
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]
    cursor = np.where(new, page.left, np.concatenate([[page.left], reach[:-1]]) if len(reach) else reach)
    ends = np.flatnonzero(np.append(new[1:], True)) if len(slot) else np.zeros(0, np.int64)
    empty = np.setdiff1d(np.arange(int(n_bands.sum())), slot[new])
    found = [
        (slot, cursor, x1, x1 - cursor >= s.min_gap),
        (slot[ends], reach[ends], np.full(len(ends), page.right), page.right - reach[ends] >= s.min_gap),
        (empty, np.full(len(empty), page.left), np.full(len(empty), page.right), np.full(len(empty), page.right - page.left >= s.min_gap)),
    ]
    slots, lefts, rights = (np.concatenate([x[k][x[3]] for x in found]) for k in range(3))
    order = np.lexsort((lefts, slots))
    slots, lefts, rights = slots[order], lefts[order], rights[order]
    owner = np.searchsorted(first_band, slots, side="right") - 1
    return owner, slots - first_band[owner], lefts, rights


def gap_groups(owner: np.ndarray, centers: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The group of each gap within its page (``owner``, ascending; ``reach`` by page): the first whose latest centre is within reach, else a new one.

    The first gaps of all pages at once, then the second ones, and so on.
    """
    n_pages = len(reach)
    first = np.searchsorted(owner, np.arange(n_pages + 1))
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")  # pages with further gaps come first
    waiting = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
    latest = np.full((n_pages, 8), np.nan)
    used = np.zeros(n_pages, np.int64)
    group = np.zeros(len(owner), np.int64)
    begin, within = first[:-1][order], reach[order]
    for k, n in enumerate(waiting.tolist()):
        gap = begin[:n] + k
        center = centers[gap]
        near = np.abs(center[:, None] - latest[:n]) <= within[:n, None]
        found = near.argmax(axis=1)
        new = ~near[np.arange(n), found]
        found[new] = used[:n][new]
        used[:n] += new
        latest[np.arange(n), found] = center
        group[gap] = found
        if used[:n].max() == latest.shape[1]:
            latest = np.hstack([latest, np.full(latest.shape, np.nan)])
    return group


def merge_strips(found: list[Strip], within: float) -> list[Strip]:
    """Strips in order of centre; one near the strip before it, as merged so far, and beside it, joins it."""
    out: list[Strip] = []
    for x in sorted(found, key=lambda x: (x[0] + x[1]) / 2):
        if out:
            y = out[-1]
            if abs((x[0] + x[1]) / 2 - (y[0] + y[1]) / 2) <= within and x[2] < y[3] and x[3] > y[2]:
                out[-1] = (min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]), max(x[4], y[4]))
                continue
        out.append(x)
    return out


def all_strips(pages: Pages, lines: np.ndarray, page: Page, s: GapSettings) -> list[list[Strip]]:
    """The strips of each page: groups of gaps, of all pages at once, that are tall and even enough."""
    owner, band, left, right = page_gaps(pages, lines, page, s)
    out: list[list[Strip]] = [[] for _ in range(len(lines))]
    if not len(owner):
        return out
    steps = np.maximum(s.band_floor, lines * s.band_lines)
    n_bands = np.ceil((page.bottom - page.top) / steps)
    centers = (left + right) / 2
    group = gap_groups(owner, centers, np.maximum(s.center_floor, lines * s.center_lines))
    order = np.lexsort((group, owner))  # stable: within a group by band
    owner, group, left, right, centers = (x[order] for x in (owner, group, left, right, centers))
    tops = page.top + band[order] * steps[owner]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(owner))
    of = owner[begin]
    top, bottom = tops[begin], np.minimum(page.bottom, tops[end - 1] + steps[of])
    rows = np.floor(tops + 0.5)
    rows_new = new.copy()
    rows_new[1:] |= rows[1:] != rows[:-1]
    coverage = s.coverage_weight * np.add.reduceat(rows_new.astype(np.int64), begin) / n_bands[of]
    # Each part of the confidence is at most its weight: what can't pass needs no statistics.
    kept = np.flatnonzero((bottom - top >= lines[of] * s.min_height_lines) & (coverage + s.width_weight + s.center_weight >= s.min_confidence - 1e-9))
    for k, p, a, b, y1, y2 in zip(kept.tolist(), of[kept].tolist(), begin[kept].tolist(), end[kept].tolist(), top[kept].tolist(), bottom[kept].tolist(), strict=True):
        widths, own = (right[a:b] - left[a:b]).tolist(), centers[a:b].tolist()
        confidence = _unit(
            float(coverage[k])
            + s.width_weight * (1 - _unit(spread(widths) / max(1, median(widths))))
            + s.center_weight * (1 - _unit(spread(own) / max(1, median(own))))
        )
        if confidence >= s.min_confidence:
            out[p].append((median(left[a:b].tolist()), median(right[a:b].tolist()), y1, y2, confidence))
    return [merge_strips(x, s.merge_within) for x in out]


def layout_bands(given: Iterable[Band], found: Sequence[Strip], line: float, page: Page, s: LayoutSettings) -> list[Band]:
    """The bands given and those above and below the strips' reach, where there is room; close ones are merged."""
    bands = list(given)
    if found:
        top, bottom, room = min(x[2] for x in found), max(x[3] for x in found), line * s.band_edge_lines
        if top > page.top + room:
            bands.append((page.top, top - page.top, s.inferred_band_confidence))
        if bottom < page.bottom - room:
            bands.append((bottom, page.bottom - bottom, s.inferred_band_confidence))
    out: list[Band] = []
    for y, height, confidence in sorted(bands, key=lambda b: b[0]):
        if out and y <= out[-1][0] + out[-1][1] + max(s.band_gap, line * s.band_gap_lines):
            start, tall, best = out[-1]
            out[-1] = (start, max(start + tall, y + height) - start, max(best, confidence))
        else:
            out.append((y, height, confidence))
    return out


def gutter_bands(tops: Sequence[float], bottoms: Sequence[float], line: float, least_lines: float, s: LayoutSettings) -> list[Band]:
    """A thin band in the middle of each stretch without text between texts, if it is ``least_lines`` high; none if that is 0."""
    out: list[Band] = []
    if least_lines <= 0 or not tops:
        return out
    reach, thin = -math.inf, line * (s.band_gap_lines or 1)
    for top, bottom in sorted(zip(tops, bottoms, strict=True)):
        if reach > -math.inf and top - reach >= least_lines * line:
            out.append(((reach + top) / 2 - thin / 2, thin, 0.95))
        reach = max(reach, bottom)
    return out


# --- paragraphs -----------------------------------------------------------------------------


class Paragraph:
    """Spans (places in the page's lists), their box, and the span whose style counts."""

    __slots__ = ("bottom", "left", "look", "right", "spans", "top")

    def __init__(self, spans: list[int], look: int, box: tuple[float, float, float, float]):
        self.spans, self.look = spans, look
        self.left, self.top, self.right, self.bottom = box

    @property
    def width(self) -> float:
        return self.right - self.left

    @property
    def area(self) -> float:
        return max(0.0, self.right - self.left) * max(0.0, self.bottom - self.top)


class Merger:
    """The merge and split rules of one page."""

    def __init__(self, columns: dict[str, list], found: list[Strip], bands: list[Band], line: float, s: LayoutSettings, band_confidence: float = 0.6):
        self.left, self.top, self.right, self.bottom, self.height = (columns[c] for c in ("left", "top", "right", "bottom", "height"))
        self.size, self.math, self.operator = (columns[c] for c in ("font_size", "is_math", "is_operator"))
        self.style = list(zip(*(columns[c] for c in ("font_family", "font_size", "weight", "font_style", "rgb")), strict=True))
        self.strips = [x for x in found if x[1] - x[0] >= s.split_strip_width and x[4] >= s.split_strip_confidence and x[3] - x[2] >= 12]
        self.bands = [b for b in bands if b[2] >= band_confidence]
        self.line, self.s = line, s
        self._alike: dict[tuple, bool] = {}

    def paragraph(self, spans: list[int], look: int | None = None) -> Paragraph:
        """Of these spans; the first one's style counts unless another is named."""
        box = (min(self.left[x] for x in spans), min(self.top[x] for x in spans), max(self.right[x] for x in spans), max(self.bottom[x] for x in spans))
        return Paragraph(spans, spans[0] if look is None else look, box)

    def reading(self, spans: Iterable[int]) -> list[int]:
        return sorted(spans, key=lambda x: (self.top[x], self.left[x]))

    def alike(self, a: int, b: int) -> bool:
        x, y, s = self.style[a], self.style[b], self.s
        if s.linear or x == y:
            return True
        known = self._alike.get((x, y))
        if known is None:
            colors = math.dist(*(((c >> 16) & 255, (c >> 8) & 255, c & 255) for c in (x[4], y[4])))
            known = x[0] == y[0] and abs(x[1] - y[1]) <= 1.0 and colors < 10 and abs(x[2] - y[2]) <= s.max_weight_difference and (s.mixed_style or x[3] == y[3])
            self._alike[x, y] = known
        return known

    def one_column(self, a: Paragraph, b: Paragraph) -> bool:
        if self.s.linear:
            return True
        wide = max(0.0, min(a.right, b.right) - max(a.left, b.left)) > 0.3 * min(a.width, b.width)
        if not self.strips:
            return wide and abs((a.left + a.right) / 2 - (b.left + b.right) / 2) < 3 * max(a.width, b.width)
        top, bottom = min(a.top, b.top), max(a.bottom, b.bottom)
        west, east = (a, b) if a.left < b.left else (b, a)
        gap = east.left - west.right
        if bottom <= top or wide or gap <= 0:
            return True
        parts = [max(0.0, min(right, east.left) - max(left, west.right)) for left, right, y1, y2, _ in self.strips if (min(bottom, y2) - max(top, y1)) / (y2 - y1) >= self.s.strip_overlap]
        return sum(x for x in parts if x >= max(3, 0.1 * gap)) / gap < self.s.same_column_coverage

    def parted(self, a: Paragraph, b: Paragraph) -> bool:
        """Is a horizontal band between the two."""
        low, high = min(a.bottom, b.bottom), max(a.top, b.top)
        return not self.s.linear and any(y > low and y + h < high for y, h, _ in self.bands)

    def related(self, a: Paragraph, b: Paragraph) -> bool:
        return self.alike(a.look, b.look) and self.one_column(a, b) and not self.parted(a, b)

    def _join(self, paragraphs: list[Paragraph], stacked: bool) -> list[Paragraph]:
        """Each paragraph takes in all later ones that follow its box as grown so far."""
        s, size, line = self.s, self.size, self.line
        align, overlap, lines, most = (s.stack_align, s.stack_overlap, s.stack_gap_lines, s.stack_gap_max) if stacked else (s.merge_align, s.merge_overlap, s.merge_gap_lines, s.merge_gap_max)
        left, out = list(paragraphs), []
        while left:
            own = Paragraph(list(left[0].spans), left[0].look, (left[0].left, left[0].top, left[0].right, left[0].bottom))
            rest, own_size = [], size[left[0].look]
            for other in left[1:]:
                gap, other_size = other.top - own.bottom, size[other.look]
                near = gap <= min(line * lines, max(own_size, other_size) * most) and not (stacked and gap < 0)
                if near and not s.linear:
                    tolerance = max(1.0, min(own_size, other_size) * align) if stacked else own_size * align
                    near = abs(own.left - other.left) < tolerance or abs(own.right - other.right) < tolerance
                    near = near or max(0.0, min(own.right, other.right) - max(own.left, other.left)) > overlap * max(1.0, min(own.width, other.width))
                if near and self.related(own, other):
                    own.spans += other.spans
                    own.left, own.top, own.right, own.bottom = min(own.left, other.left), min(own.top, other.top), max(own.right, other.right), max(own.bottom, other.bottom)
                else:
                    rest.append(other)
            out.append(own)
            left = rest
        return out

    def merge(self, paragraphs: list[Paragraph]) -> list[Paragraph]:
        """Merges in the order given; a paragraph may reach back over the box before it."""
        return self._join(paragraphs, False)

    def stack(self, paragraphs: list[Paragraph]) -> list[Paragraph]:
        """Downward merges in order of boxes, until nothing changes."""
        while True:
            merged = self.stack_once(paragraphs)
            if len(merged) == len(paragraphs):
                return merged
            paragraphs = merged

    def stack_once(self, paragraphs: list[Paragraph]) -> list[Paragraph]:
        return self._join(sorted(paragraphs, key=lambda p: (p.top, p.left)), True)

    def formula(self, a: Paragraph, b: Paragraph) -> bool:
        if not any(self.math[x] for p in (a, b) for x in p.spans) or not self.one_column(a, b):
            return False
        size = max(self.size[a.look], self.size[b.look]) or 12
        if abs(a.top - b.top) >= size * self.s.math_baseline:
            return False
        if any(self.operator[x] for p in (a, b) for x in p.spans):
            return abs(a.left - b.left) < size * self.s.math_left
        return abs((a.left + a.right) - (b.left + b.right)) / 2 < size * self.s.math_center

    def nested(self, a: Paragraph, b: Paragraph) -> bool:
        """Does one hold the other, up to a unit, or do they share much of the smaller."""
        for p, q in ((a, b), (b, a)):
            if p.left - 1 <= q.left and p.right + 1 >= q.right and p.top - 1 <= q.top and p.bottom + 1 >= q.bottom:
                return True
        width, height = min(a.right, b.right) - max(a.left, b.left), min(a.bottom, b.bottom) - max(a.top, b.top)
        return width > 0 and height > 0 and width * height / (min(a.area, b.area) or 1) > self.s.nested_overlap

    def near_pairs(self, paragraphs: list[Paragraph]) -> list[list[int]]:
        """For each paragraph the others that are nested with it, or one of the two has math: from all boxes at once."""
        boxes = np.array([(p.left, p.top, p.right, p.bottom, p.area) for p in paragraphs]).reshape(-1, 5)
        left, top, right, bottom, area = (boxes[:, k] for k in range(5))
        holds = (left[:, None] - 1 <= left) & (right[:, None] + 1 >= right) & (top[:, None] - 1 <= top) & (bottom[:, None] + 1 >= bottom)
        width, height = np.minimum(right[:, None], right) - np.maximum(left[:, None], left), np.minimum(bottom[:, None], bottom) - np.maximum(top[:, None], top)
        smaller = np.minimum(area[:, None], area)
        shared = (width > 0) & (height > 0) & (width * height / np.where(smaller == 0, 1.0, smaller) > self.s.nested_overlap)
        math_ = np.array([any(self.math[x] for x in p.spans) for p in paragraphs], bool)
        found = holds | holds.T | shared | math_[:, None] | math_
        return [np.flatnonzero(row).tolist() for row in found]

    def nest(self, paragraphs: list[Paragraph]) -> tuple[list[Paragraph], bool]:
        """One pass: a paragraph merges with the first other that is nested with it or of its formula.

        What is made has the style of its first span in reading order from then on.
        """
        near = self.near_pairs(paragraphs)
        used: set[int] = set()
        out, changed = [], False
        for i, a in enumerate(paragraphs):
            if i in used:
                continue
            used.add(i)
            for j in near[i]:
                b = paragraphs[j]
                if j not in used and self.related(a, b) and (self.nested(a, b) or self.formula(a, b)):
                    # On equal places the larger one's spans come first.
                    spans = [*a.spans, *b.spans] if a.area >= b.area else [*b.spans, *a.spans]
                    a = self.paragraph(self.reading(spans))
                    used.add(j)
                    changed = True
                    break
            out.append(a)
        return out, changed

    def split(self, paragraphs: list[Paragraph]) -> list[Paragraph]:
        """Where a page has strips, cut paragraphs at wide gaps inside their lines."""
        if self.s.linear or not self.strips:
            return paragraphs
        return [part for p in paragraphs for part in self._cut(p)]

    def _cut(self, p: Paragraph) -> list[Paragraph]:
        s, ordered = self.s, self.reading(p.spans)
        lines: list[list[int]] = []
        for x in ordered:
            if lines and abs(self.top[x] - self.top[lines[-1][0]]) <= s.split_line_height * s.split_line:
                lines[-1].append(x)
            else:
                lines.append([x])
        wide = []
        for line in lines:
            line.sort(key=lambda x: self.left[x])
            for a, b in zip(line, line[1:], strict=False):
                gap, size = self.left[b] - self.right[a], 0.8 * min(self.height[a], self.height[b])
                if gap > size * s.column_gap and gap > size * s.word_gap:
                    wide.append((self.right[a] + self.left[b]) / 2)
        cuts: list[float] = []
        for x in sorted(wide):
            if not cuts or x - cuts[-1] > s.split_line_height * s.split_dedup:
                cuts.append(x)
        if not cuts:
            return [p]
        parts: dict[int, list[int]] = {}
        for x in ordered:
            center = (self.left[x] + self.right[x]) / 2
            parts.setdefault(sum(center >= c for c in cuts), []).append(x)
        return [self.paragraph(v) for _, v in sorted(parts.items())] if len(parts) > 1 else [p]


def estimate_line(columns: dict[str, list], groups: Iterable[list[int]], page: Page, s: LayoutSettings) -> float:
    """Line height of a page: a trimmed mean of the gaps inside paragraphs, if there are enough, not under a share of the median font."""
    top, bottom = columns["top"], columns["bottom"]
    gaps = sorted(g for p in groups for a, b in zip(p, p[1:], strict=False) if 0 < (g := top[b] - bottom[a]) < s.max_gap_of_page * (page.bottom - page.top))
    mean = 0.0
    if len(gaps) >= s.min_gaps_for_trim:
        cut = math.floor(len(gaps) * s.trim)
        gaps = gaps[cut : len(gaps) - cut]
        mean = sum(gaps) / len(gaps) * s.line_from_gaps if gaps else 0.0
    sizes = [x for x in columns["font_size"] if x > 0]
    if not sizes:
        return 16.0
    return max(mean, median(sizes) * s.line_height * s.line_floor) or median(sizes) * s.line_height


@dataclass
class Profile:
    """What is known of a page before its paragraphs are merged."""

    text_line: float
    line: float
    strips: list[Strip]  # those that count for columns
    bands: list[Band]


COLUMNS = ("para_id", "left", "top", "right", "bottom", "height", "font_size", "font_family", "font_style", "weight", "rgb", "is_math", "is_operator")


def profiles(pages: Pages, page: Page, s: LayoutSettings, gaps: GapSettings, gutters: float = 0.0) -> Iterator[tuple[Profile, dict[str, list], list[list[int]]]]:
    """Each page's profile, columns and first paragraphs."""
    lines = text_lines(pages, gaps)
    found = all_strips(pages, lines, page, gaps)
    columns = {c: pages.column(c).tolist() for c in COLUMNS}
    for k, (a, b) in enumerate(zip(pages.begin.tolist(), pages.end.tolist(), strict=True)):
        own = {c: v[a:b] for c, v in columns.items()}
        groups: dict[int, list[int]] = {}
        for x, p in enumerate(own["para_id"]):
            groups.setdefault(p, []).append(x)
        first = [v for _, v in sorted(groups.items())]
        line = estimate_line(own, first, page, s)
        kept = [x for x in found[k] if x[4] >= s.min_strip_confidence and x[1] - x[0] >= s.min_strip_width]
        given = gutter_bands(own["top"], own["bottom"], line, gutters, s)
        yield Profile(float(lines[k]), line, kept, layout_bands(given, kept, line, page, s)), own, first


def merged(profile: Profile, columns: dict[str, list], first: list[list[int]], s: LayoutSettings, gaps: GapSettings) -> list[list[int]]:
    """Places of the spans of each paragraph of a page, in order."""
    m = Merger(columns, profile.strips, profile.bands, profile.line, s, gaps.band_confidence)
    paragraphs = m.merge(m.split([m.paragraph(p) for p in first]))
    for _ in range(s.max_rounds):
        paragraphs, changed = m.nest(paragraphs)
        if not changed:
            break
        paragraphs = m.merge(m.split(paragraphs))
    return [m.reading(p.spans) for p in m.stack(paragraphs)]


def one_step(step: str, profile: Profile, columns: dict[str, list], first: list[list[int]], s: LayoutSettings, gaps: GapSettings) -> list[list[int]]:
    """Places of the spans of each paragraph after one step on a page's first paragraphs: split, merge, stack or nest."""
    m = Merger(columns, profile.strips, profile.bands, profile.line, s, gaps.band_confidence)
    paragraphs = [m.paragraph(p) for p in first]
    steps = {"split": m.split, "merge": m.merge, "stack": m.stack_once, "nest": lambda x: m.nest(x)[0]}
    return [p.spans for p in steps[step](paragraphs)]


# --- units ----------------------------------------------------------------------------------


def html_lines(spans: Iterable[int], columns: dict[str, list]) -> str:
    """The spans' html by lines of rounded top, in each by left."""
    lines: dict[int, list[tuple[float, int, str]]] = {}
    for x in spans:
        lines.setdefault(math.floor(columns["top"][x] + 0.5), []).append((columns["left"][x], columns["span_id"][x], columns["html"][x]))
    return "<br>".join(" ".join(html for *_, html in sorted(own)) for _, own in sorted(lines.items()))


def unit_parts(name: str, spans: list[int], columns: dict[str, list], budget: int) -> Iterator[tuple[str, list[int]]]:
    """A paragraph, or its sentences if its html is over budget; a sentence ends with a span that ends one."""
    if len(html_lines(spans, columns)) <= budget:
        yield name, spans
        return
    own: list[int] = []
    k = 0
    ordered = sorted(spans, key=lambda x: (columns["top"][x] // 5, columns["left"][x], columns["span_id"][x]))
    for x in ordered:
        own.append(x)
        if columns["ends"][x] or x == ordered[-1]:
            yield f"{name}-sent-{k}", own
            own, k = [], k + 1


def span_set(spans: list[int], columns: dict[str, list], page: Page, family: str) -> tuple[float, float, float, float, list[float], str]:
    """Box from the page's corner, sizes in order, and the first family that is not the default."""
    edges = (min(columns["left"][x] for x in spans) - page.left, min(columns["top"][x] for x in spans) - page.top, max(columns["right"][x] for x in spans) - page.left, max(columns["bottom"][x] for x in spans) - page.top)
    return *edges, [columns["size"][x] for x in spans], next((columns["name"][x] for x in spans if columns["name"][x]), family)


# --- segments -------------------------------------------------------------------------------


def segments(left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, line: float, page: Page, s: SegmentSettings) -> list[tuple[float, float, float, float, int]]:
    """top, bottom, left, right, columns: stretches of a page with the same number of columns; the whole page where there are none."""
    whole = [(page.top, page.bottom, page.left, page.right, 1)]
    step = max(s.step_floor, s.step_lines * line)
    ys = page.top + step * np.arange(math.ceil((page.bottom - page.top) / step))
    order = np.argsort(left, kind="stable")
    left, top, right, bottom = left[order], top[order], right[order], bottom[order]
    here = (top <= ys[:, None]) & (bottom >= ys[:, None])
    samples = []  # y, columns, left, right
    for y, row in zip(ys[here.any(axis=1)].tolist(), here[here.any(axis=1)], strict=True):
        lefts = left[row].tolist()
        n, column = 1, lefts[0]
        for x in lefts:
            if x - column > s.column_gap_lines * line:
                n, column = n + 1, x
        samples.append((y, n, lefts[0], float(right[row].max())))
    if not samples:
        return whole

    last, shift = samples[0], s.shift_lines * line
    parts = [[page.top, last[0], last[2], last[3], last[1]]]
    for x in samples[1:]:
        if x[1] != last[1] or abs(x[2] - last[2]) > shift or abs(x[3] - last[3]) > shift:
            parts.append([last[0], x[0], x[2], x[3], x[1]])
            last = x
    parts[-1][1] = page.bottom

    least, joined = s.min_height_lines * line, [parts[0]]
    for x in parts[1:]:
        own = joined[-1]
        if own[1] - own[0] < least or x[4] == own[4]:  # a short one goes into the next, with its own number of columns
            own[1], own[2], own[3] = x[1], min(own[2], x[2]), max(own[3], x[3])
        else:
            joined.append(x)
    out = []
    for a, b, x1, x2, n in joined:
        if b - a > least:
            room = min(line * s.buffer_lines, (b - a) * s.buffer_share)
            out.append((max(page.top, a - room), min(page.bottom, b + room), x1, x2, n))
    return out or whole
