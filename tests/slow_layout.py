"""A plain second implementation of the page layout, for comparison: dictionaries, no sharing of code, everything worked out anew each time.

Spans are dicts with id, text, left, top, right, bottom, size, family, style, weight, rgb.
"""

import math
import re
from statistics import median, stdev

MATH = re.compile(r"[=+\-−×÷√∫∑∏∞Δαβγδθλμρστφψω±≤≥≠≈≡%‰∀∃∈∋∩∪⊂⊃⊆⊇⊕⊗⊥⇒⇔→←↑↓↔∴≅⊢⊨]|[Ͱ-Ͽ⁰-₟]")
FONT = re.compile("math|cambria|stix|asana|euler|latin modern", re.I)


def is_math(x):
    return bool(x["text"]) and bool(FONT.search(x["family"]) or MATH.search(x["text"]))


def box(spans):
    return tuple(f(x[k] for x in spans) for k, f in (("left", min), ("top", min), ("right", max), ("bottom", max)))


def reading(spans):
    return sorted(spans, key=lambda x: (x["top"], x["left"]))


def alike(a, b):
    return a["family"] == b["family"] and abs(a["size"] - b["size"]) <= 1 and math.dist(a["rgb"], b["rgb"]) < 10 and abs(a["weight"] - b["weight"]) <= 300


def first_groups(spans):
    groups = []
    for x in sorted(spans, key=lambda x: (x["top"], x["left"], x["id"])):
        if groups:
            p = groups[-1][-1]
            small, large, formula = min(x["size"], p["size"]), max(x["size"], p["size"]), is_math(x) or is_math(p)
            aligned = abs(x["left"] - p["left"]) < 2 * small or abs(x["right"] - p["right"]) < 2 * small
            below = x["top"] - p["bottom"] <= min(large * 1.6 * 1.3, large * 2.2) and aligned
            beside = abs(x["bottom"] - p["bottom"]) < small * (0.75 if formula else 0.45) and 0 <= x["left"] - p["right"] < small * (0.9 if formula else 0.55)
            goes_on = p["text"].strip()[-1:] in ("-", "­") and p["text"].strip() and x["top"] > p["top"] and abs(x["left"] - p["left"]) < x["size"] * 1.8
            if alike(x, p) and (below or beside or goes_on):
                groups[-1].append(x)
                continue
        groups.append([x])
    return groups


def line_height(groups, height=792):
    gaps = sorted(b["top"] - a["bottom"] for g in groups for a, b in zip(g, g[1:], strict=False) if 0 < b["top"] - a["bottom"] < height / 2)
    least = median(x["size"] for g in groups for x in g) * 1.6 * 0.8
    if len(gaps) < 5:
        return least
    cut = int(len(gaps) * 0.15)
    inner = gaps[cut : len(gaps) - cut]
    return max(sum(inner) / len(inner) * 1.25, least)


def strips(spans, width=612, height=792):
    tall = [x["bottom"] - x["top"] for x in spans if x["bottom"] - x["top"] > 3]
    line = median(tall) if tall else 15
    step = max(6, line * 0.75)
    bands = [(k * step, min(height, (k + 1) * step)) for k in range(math.ceil(height / step))]
    clusters = []
    for y1, y2 in bands:
        inside = [x for x in spans if x["bottom"] > y1 and x["top"] < y2]
        edge, gaps = 0.0, []
        for x in sorted(inside, key=lambda x: x["left"]):
            gaps.append((edge, x["left"]))
            edge = max(edge, x["right"])
        for left, right in [*gaps, (edge, width)]:
            if right - left >= 2:
                near = [c for c in clusters if abs((left + right) / 2 - (c[-1][0] + c[-1][1]) / 2) <= max(4, line / 2)]
                (near[0] if near else clusters.append([]) or clusters[-1]).append((left, right, y1, y2))
    found = []
    for c in clusters:
        top, bottom = min(g[2] for g in c), max(g[3] for g in c)
        widths, centers = [g[1] - g[0] for g in c], [(g[0] + g[1]) / 2 for g in c]

        def steady(values):
            return 1 - min(1, (stdev(values) if len(values) > 1 else 0) / max(1, median(values)))

        confidence = 0.5 * len({math.floor(g[2] + 0.5) for g in c}) / len(bands) + 0.25 * steady(widths) + 0.25 * steady(centers)
        if bottom - top >= 1.5 * line and confidence >= 0.6:
            found.append([median(g[0] for g in c), median(g[1] for g in c), top, bottom, min(1, confidence)])
    out = []
    for x in sorted(found, key=lambda x: x[0] + x[1]):
        if out and abs(sum(x[:2]) - sum(out[-1][:2])) <= 6 and min(x[3], out[-1][3]) > max(x[2], out[-1][2]):
            y = out.pop()
            x = [min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]), max(x[4], y[4])]
        out.append(x)
    return [x for x in out if x[4] >= 0.7 and x[1] - x[0] >= 4]


def bands_of(found, line, height=792):
    if not found:
        return []
    top, bottom = min(x[2] for x in found), max(x[3] for x in found)
    out = [(0, top)] if top > 0.75 * line else []
    if bottom < height - 0.75 * line:
        if out and bottom <= out[0][1] + max(2, 0.2 * line):
            return [(0, height)]
        out.append((bottom, height))
    return out


def layout(spans):
    """Ids of the spans of each paragraph."""
    if not spans:
        return []
    groups = first_groups(spans)
    line, columns = line_height(groups), strips(spans)
    bands = bands_of(columns, line)
    walls = [x for x in columns if x[1] - x[0] >= 6 and x[3] - x[2] >= 12 and x[4] >= 0.7]

    def one_column(a, b):
        shared = max(0, min(a[2], b[2]) - max(a[0], b[0]))
        some = shared > 0.3 * min(a[2] - a[0], b[2] - b[0])
        if not walls:
            return some and abs(a[0] + a[2] - b[0] - b[2]) / 2 < 3 * max(a[2] - a[0], b[2] - b[0])
        y1, y2 = min(a[1], b[1]), max(a[3], b[3])
        x1, x2 = (a[2], b[0]) if a[0] < b[0] else (b[2], a[0])
        if some or y1 >= y2 or x1 >= x2:
            return True
        filled = 0
        for left, right, top, bottom, _ in walls:
            part = max(0, min(right, x2) - max(left, x1))
            if (min(y2, bottom) - max(y1, top)) / (bottom - top) >= 0.6 and part >= max(3, 0.1 * (x2 - x1)):
                filled += part
        return filled / (x2 - x1) < 0.65

    def apart(a, b):
        return any(y1 > min(a[3], b[3]) and y2 < max(a[1], b[1]) for y1, y2 in bands)

    def may_join(g, h, g_style, h_style):
        return alike(g_style, h_style) and one_column(box(g), box(h)) and not apart(box(g), box(h))

    def absorb(groups, styles, downward):
        out = []
        while groups:
            own, style = list(groups[0]), styles[0]
            rest, rest_styles = [], []
            for h, h_style in zip(groups[1:], styles[1:], strict=True):
                a, b = box(own), box(h)
                room = min(1.35 * line, 2 * max(style["size"], h_style["size"]))
                reach = max(1, 2 * min(style["size"], h_style["size"])) if downward else 2 * style["size"]
                shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) > 0.25 * max(1, min(a[2] - a[0], b[2] - b[0]))
                fits = b[1] - a[3] <= room and (b[1] >= a[3] or not downward) and (abs(a[0] - b[0]) < reach or abs(a[2] - b[2]) < reach or shared)
                if fits and may_join(own, h, style, h_style):
                    own += h
                else:
                    rest.append(h)
                    rest_styles.append(h_style)
            out.append((own, style))
            groups, styles = rest, rest_styles
        return out

    def merge(groups):
        return [g for g, _ in absorb(groups, [g[0] for g in groups], False)]

    def split(groups):
        out = []
        for g in groups:
            cuts = set()
            for y in {x["top"] for x in g}:
                row = sorted((x for x in g if x["top"] == y), key=lambda x: x["left"])
                for a, b in zip(row, row[1:], strict=False):
                    unit = 0.8 * min(a["bottom"] - a["top"], b["bottom"] - b["top"])
                    if b["left"] - a["right"] > 2.5 * unit:
                        cuts.add((a["right"] + b["left"]) / 2)
            pieces = {}
            for x in reading(g):
                pieces.setdefault(sum((x["left"] + x["right"]) / 2 >= c for c in cuts), []).append(x)
            out += [pieces[k] for k in sorted(pieces)] if walls and len(pieces) > 1 else [g]
        return out

    def inside(a, b):
        return a[0] - 1 <= b[0] and a[1] - 1 <= b[1] and a[2] + 1 >= b[2] and a[3] + 1 >= b[3]

    def surface(a):
        return max(0, a[2] - a[0]) * max(0, a[3] - a[1])

    def belongs(g, h):
        a, b = box(g), box(h)
        if inside(a, b) or inside(b, a):
            return True
        common = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
        if common[0] < common[2] and common[1] < common[3] and surface(common) / (min(surface(a), surface(b)) or 1) > 0.7:
            return True
        if not any(is_math(x) for x in g + h):
            return False
        unit = max(g[0]["size"], h[0]["size"]) or 12
        signs = any(c in "=+-−×÷√∫∑≠≤≥≈±∞" for x in g + h for c in x["text"])
        close = abs(a[0] - b[0]) < 1.5 * unit if signs else abs(a[0] + a[2] - b[0] - b[2]) / 2 < 2.5 * unit
        return abs(a[1] - b[1]) < 2 * unit and close

    groups = merge(split(groups))
    for _ in range(10):
        out, taken = [], set()
        for i, g in enumerate(groups):
            if i in taken:
                continue
            taken.add(i)
            partner = next((j for j, h in enumerate(groups) if j not in taken and may_join(g, h, g[0], h[0]) and belongs(g, h)), None)
            if partner is None:
                out.append(g)
            else:
                taken.add(partner)
                h = groups[partner]
                out.append(reading(g + h if surface(box(g)) >= surface(box(h)) else h + g))
        changed = len(out) < len(groups)
        groups = out
        if not changed:
            break
        groups = merge(split(groups))
    stacked = [(g, g[0]) for g in groups]
    while True:
        stacked.sort(key=lambda p: (box(p[0])[1], box(p[0])[0]))
        fewer = absorb([g for g, _ in stacked], [style for _, style in stacked], True)
        if len(fewer) == len(stacked):
            return [[x["id"] for x in reading(g)] for g, _ in fewer]
        stacked = fewer


def segments(spans, line, width=612, height=792):
    """top, bottom, left, right, columns."""
    step, profile = max(5, line / 2), []
    for k in range(math.ceil(height / step)):
        y = k * step
        here = [x for x in spans if x["top"] <= y <= x["bottom"]]
        if here:
            starts = []
            for x in sorted(x["left"] for x in here):
                if not starts or min(abs(x - c) for c in starts) > 2 * line:
                    starts.append(x)
            profile.append((y, len(starts), min(x["left"] for x in here), max(x["right"] for x in here)))
    if not profile:
        return [(0, height, 0, width, 1)]
    turns = [profile[0]]
    for x in profile[1:]:
        if x[1] != turns[-1][1] or max(abs(x[2] - turns[-1][2]), abs(x[3] - turns[-1][3])) > 4 * line:
            turns.append(x)
    raw = [{"top": 0 if k == 0 else turns[k - 1][0], "bottom": t[0], "left": t[2], "right": t[3], "n": t[1]} for k, t in enumerate(turns)]
    raw[-1]["bottom"] = height
    done = [raw[0]]
    for x in raw[1:]:
        own = done[-1]
        if own["bottom"] - own["top"] < 2 * line or own["n"] == x["n"]:
            done[-1] = {"top": own["top"], "bottom": x["bottom"], "left": min(own["left"], x["left"]), "right": max(own["right"], x["right"]), "n": own["n"]}
        else:
            done.append(x)
    out = []
    for x in done:
        tall = x["bottom"] - x["top"]
        if tall > 2 * line:
            extra = min(line / 2, tall / 10)
            out.append((max(0, x["top"] - extra), min(height, x["bottom"] + extra), x["left"], x["right"], x["n"]))
    return out or [(0, height, 0, width, 1)]
