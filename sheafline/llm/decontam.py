"""Benchmark decontamination by template canonicalisation.

Texts become tokens: runs of letters, marks and digits of any script, case folded
where that keeps a character's bytes as many as they were (so not I with a dot).
Numbers, units after numbers, and runs of names inside sentences become typed
placeholders. Two sequences are matched: the literal one and the template. Windows
of five tokens are hash-joined with the benchmark's. The benchmark lies in the
shared folder; tasks read it in blocks of bounded bytes and items, index a block's
window hashes, and probe them while they read the documents, so that neither windows
nor texts are shuffled, nothing passes through the driver, and documents are read once.
A worker keeps blocks up to ``keep_bytes``; a larger benchmark is read anew for each
``window_bytes`` of text.

For a (document, item) pair, matched windows inside a stretch about as long as
the item count. Template windows are believed only if their slots are
consistent: one benchmark value goes with one document value, and the other way
round, throughout the text, or else throughout one place of about the item's
length, as a text may hold an item more than once, with other values each time. Items
alike but for their slots' values (same template, slots as wide, equal values in the
same slots), as generated question sets have them by thousands, are judged once for
all: each has its own verdict only where literal windows with its values are in the text. A
pair is a leak if windows matched cover ``coverage`` of the item's, or a run of at
least ``run_tokens`` tokens agrees.

Defined cases: signs of four bytes (emoji) are no words; null or token-less texts and items match nothing. An item whose
sequence has three or four tokens has one window, all of it, which is looked for
everywhere in texts; an item of one or two tokens matches only a text that is nothing
else. Repeated items and rows are reported each; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import BASE, KEPT, LOWER, Texts, column, map_batches, mix, slices, span_hash
from sheafline.session import fresh_path, ship

U64 = np.uint64
SCHEMA = "doc_id long, item_id long, coverage double, run_tokens long, kind string, slots string, start_byte long, end_byte long"
_CLASS = np.zeros(256, np.int8)  # 0 separator, 1 letter, 2 digit
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_ENDER = np.zeros(256, bool)
_ENDER[[ord(c) for c in ".!?:;\n\"()[]|"]] = True
# Names of units, lower case.
UNITS = "mm cm dm km kg mg g lb lbs oz ml l kl ft mi mph kmh kph hz khz mhz ghz kb mb gb tb kw kwh mw w v hours hour minutes minute seconds second sec min hr hrs days day weeks week months month years year meters meter metres metre kilometers kilometres kilometer kilometre miles mile inches inch feet foot yards yard grams gram kilograms kilogram pounds pound ounces ounce liters liter litres litre gallons gallon dollars dollar cents cent euros euro percent degrees degree celsius fahrenheit acres acre tons ton tonnes usd eur gbp stunden minuten sekunden tage jahre heures jours ans horas minutos dias".split()
NUMBER, UNIT, NAME = (U64(x) for x in (0x1111111111111111, 0x2222222222222223, 0x3333333333333335))


@dataclass(frozen=True)
class LeakSettings:
    window: int = 5
    coverage: float = 0.4
    run_tokens: int = 13
    min_literals: int = 3  # of the tokens of a template window
    slot_agreement: float = 0.8
    block_items: int = 20_000  # benchmark items in one block, at most
    block_bytes: int = 1 << 23  # of their texts, or one longer item
    keep_bytes: int = 1 << 25  # of the texts of the blocks that a worker keeps
    window_bytes: int = 1 << 26  # of documents for which blocks beyond those are read once


def _hash_words(words: list[str]) -> np.ndarray:
    texts = Texts(pa.array(words))
    return span_hash(texts.prefix(), texts.start, texts.end)


@dataclass
class Tokens:
    """Literal and template tokens of some rows; each template token covers literal ones from ``first`` to before the next's."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    literal: np.ndarray
    template: np.ndarray
    first: np.ndarray
    slot: np.ndarray  # of each template token: is it a placeholder
    template_row: np.ndarray
    folded: np.ndarray  # the rows' bytes, case folded


@lru_cache(maxsize=2)
def _wide(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the characters of ``width`` UTF-8 bytes, by code: folded bytes, class (0 or 1), is it a capital."""
    codes = 1 << (5 * width + 1)
    folded, kind, upper = np.zeros((codes, width), np.uint8), np.zeros(codes, np.int8), np.zeros(codes, bool)
    for code in range(1 << (7 if width == 2 else 11), codes):
        if 0xD800 <= code < 0xE000:  # surrogates are no characters
            continue
        c = chr(code)
        low = c.casefold().encode()
        folded[code] = list(low if len(low) == width else c.encode())
        kind[code] = unicodedata.category(c)[0] in "LMN"
        upper[code] = c.isupper()
    return folded, kind, upper


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: folded, class, is its character a capital."""
    folded, kind, upper = LOWER[data], _CLASS[data], (data >= 65) & (data <= 90)
    for width, lead, last in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF)):
        at = np.flatnonzero((data >= lead) & (data <= last))
        if not len(at):
            continue
        code = data[at].astype(np.int64) & (0x3F >> (width - 1))
        for k in range(1, width):
            code = code << 6 | data[at + k] & 0x3F
        low, word, capital = _wide(width)
        for k in range(width):
            folded[at + k], kind[at + k], upper[at + k] = low[code, k], word[code], capital[code]
    at = np.flatnonzero((data >= 0xF0) & (data <= 0xF4))
    if len(at):  # few characters, looked up one by one: letters of rare scripts, and signs, which are no words
        code = data[at].astype(np.int64) & 7
        for k in range(1, 4):
            code = code << 6 | data[at + k] & 0x3F
        seen, of = np.unique(code, return_inverse=True)
        found = [chr(c) for c in seen.tolist()]
        low = [x if len(x) == 4 else c.encode() for c, x in ((c, c.casefold().encode()) for c in found)]
        word, capital = np.array([unicodedata.category(c)[0] in "LMN" for c in found], np.int8), np.array([c.isupper() for c in found])
        for k in range(4):
            folded[at + k], kind[at + k], upper[at + k] = np.array([x[k] for x in low], np.uint8)[of], word[of], capital[of]
    return folded, kind, upper


def tokenize(texts: Texts) -> Tokens:
    data = texts.data
    folded, kind, capital = _characters(data)
    if len(data) > 2:  # . and , between digits belong to the number
        joint = ((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == 2) & (kind[2:] == 2)
        kind[1:-1][joint] = 2
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[texts.start] = True
    edge[texts.end] = True
    cut = np.flatnonzero(edge)
    s, e = cut[:-1], cut[1:]
    word = kind[s] > 0 if len(s) else np.zeros(0, bool)
    s, e = s[word], e[word]
    row = np.searchsorted(texts.end, s, side="right")
    literal = span_hash(texts.prefix(folded), s, e)
    number = kind[s] == 2 if len(s) else np.zeros(0, bool)
    first_of_row = np.ones(len(s), bool)
    first_of_row[1:] = row[1:] != row[:-1]
    after_number = np.zeros(len(s), bool)
    after_number[1:] = number[:-1] & ~first_of_row[1:]
    unit = after_number & ~number
    unit[unit] = np.isin(literal[unit], _hash_words(UNITS))
    enders = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ENDER[data], out=enders[1:])
    opens = first_of_row.copy()
    if len(s):
        opens[1:] |= enders[s[1:]] > enders[e[:-1]]
    name = capital[s] & ~opens & ~number & ~unit
    same_name = np.zeros(len(s), bool)
    same_name[1:] = name[1:] & name[:-1]
    first = np.flatnonzero(~same_name)
    template = literal.copy()
    template[number], template[unit], template[name] = NUMBER, UNIT, NAME
    slot = number | unit | name
    return Tokens(s, e, row, literal, template[first], first, slot[first], row[first], folded)


def _window_hashes(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each window of n values of one row."""
    count = max(len(values) - n + 1, 0)
    total = np.zeros(count, U64)
    for k in range(n):
        total = total * U64(BASE) + values[k : k + count]
    at = np.flatnonzero(row[:count] == row[n - 1 :]) if count else np.zeros(0, np.int64)
    return mix(total[at] + U64(n)), at


def _whole_hashes(values: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each row of one or two values, told apart from windows of as many."""
    found = [_window_hashes(values, row, n) for n in (1, 2)]
    found = [(mix(keys ^ U64(0x57401E)), at, size[row[at]] == n) for n, (keys, at) in enumerate(found, 1)]
    return np.concatenate([keys[ok] for keys, _, ok in found]), np.concatenate([at[ok] for _, at, ok in found])


class Side:
    """The windows of some items in one sequence, sorted by hash; ``own`` tells which of those are a member's own.

    Of items alike in all but their slots' values the first has all windows, the others only
    those with a slot (``in_slot``) in the literal sequence, none in the template sequence.
    """

    def __init__(self, values: np.ndarray, row: np.ndarray, slot: np.ndarray | None, n: int, s: LeakSettings, first: np.ndarray, in_slot: np.ndarray):
        size = np.bincount(row, minlength=n)
        self.width = np.clip(size, 1, s.window)  # of each item's windows
        self.n_windows = np.maximum(size - s.window + 1, 1)
        self.widths = [s.window, *(w for w in range(3, s.window) if (size == w).any())]
        found = [_window_hashes(values, row, w) for w in self.widths]
        found = [(keys[ok], at[ok]) for w, (keys, at) in zip(self.widths, found, strict=True) for ok in [self.width[row[at]] == w]]
        found.append(_whole_hashes(values, row, size))
        keys, at = (np.concatenate(x) for x in zip(*found, strict=True))
        if slot is not None:  # windows without a slot are the literal ones
            before = np.concatenate([[0], np.cumsum(slot)])
            width = self.width[row[at]]
            n_slots = before[at + width] - before[at]
            ok = (n_slots > 0) & (width - n_slots >= s.min_literals)
            keys, at = keys[ok], at[ok]
        before = np.concatenate([[0], np.cumsum(in_slot)])
        own = before[at + self.width[row[at]]] > before[at] if slot is None else np.zeros(len(at), bool)
        wanted = own | (first[row[at]] == row[at])
        keys, at, own = keys[wanted], at[wanted], own[wanted]
        order = np.argsort(keys)
        self.keys, self.at, self.own = keys[order], at[order], own[order]
        self.row = row[self.at]

    def windows_of(self, values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first index of the windows of n texts, of all widths that these items have."""
        found = [_window_hashes(values, row, w) for w in self.widths]
        found.append(_whole_hashes(values, row, np.bincount(row, minlength=n)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Block:
    """Some benchmark items, with their windows and a bit table before the search."""

    def __init__(self, items: list[tuple[int, str]], settings: LeakSettings):
        self.ids = [i for i, _ in items]
        self.settings = settings
        texts = Texts(pa.array([t for _, t in items], pa.string()))
        self.nbytes = len(texts.data)
        self.tokens = t = tokenize(texts)
        raw = t.folded.tobytes()
        self.words = [raw[a:b] for a, b in zip(t.start, t.end, strict=True)]
        self.members: dict[int, list[int]] = {}
        first = self._alike(len(items))
        width = np.diff(np.append(t.first, len(t.row)))
        self.sides = {"literal": Side(t.literal, t.row, None, len(items), settings, first, np.repeat(t.slot, width)), "template": Side(t.template, t.template_row, t.slot, len(items), settings, first, t.slot)}
        self.bits = np.zeros(1 << 22, bool)
        for side in self.sides.values():
            self.bits[(side.keys >> U64(42)).astype(np.int64)] = True

    def _alike(self, n: int) -> np.ndarray:
        """For each item the first that has its template, slots as wide, and equal values in the same slots."""
        t = self.tokens
        self.template_at = np.searchsorted(t.template_row, np.arange(n + 1))
        self.literal_at = np.searchsorted(t.row, np.arange(n + 1))
        ends = np.append(t.first, len(t.row))
        first, known = np.arange(n), {}
        for k in range(n):
            a, b = int(self.template_at[k]), int(self.template_at[k + 1])
            seen: dict[bytes, int] = {}
            pattern = [seen.setdefault(self.value(j), len(seen)) for j in np.flatnonzero(t.slot[a:b]) + a]
            key = (t.template[a:b].tobytes(), np.diff(ends[a : b + 1]).tobytes(), tuple(pattern))
            first[k] = known.setdefault(key, k)
            if first[k] != k:
                self.members.setdefault(int(first[k]), [int(first[k])]).append(k)
        self.first = first
        return first

    def value(self, j: int) -> bytes:
        """What a template token stands for."""
        ends = self.tokens.first
        return b" ".join(self.words[ends[j] : ends[j + 1] if j + 1 < len(ends) else len(self.words)])

    def hits(self, side: Side, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the texts' windows with equal ones here; the first of these and their number."""
        near = np.flatnonzero(self.bits[(keys >> U64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(side.keys, keys[near], side="left"), np.searchsorted(side.keys, keys[near], side="right")
        some = hi > lo
        return near[some], lo[some], (hi - lo)[some]


def _leaks(texts: Texts, block: Block, most_pairs: int = 1 << 20) -> Iterator[tuple]:
    """row, item index, coverage, run, kind, slots, start, end of each leak; pairs of windows are laid out for some rows at a time."""
    t = tokenize(texts)
    found = []
    for name, values, row in (("literal", t.literal, t.row), ("template", t.template, t.template_row)):
        side = block.sides[name]
        keys, at = side.windows_of(values, row, texts.n)
        near, lo, n = block.hits(side, keys)
        place = at[near]
        order = np.argsort(place, kind="stable")
        found.append((name, side, place[order], row[place[order]], lo[order], n[order]))
    per_row = sum(np.bincount(row, weights=n, minlength=texts.n) for *_, row, _, n in found)
    group = np.cumsum(per_row) // most_pairs
    rest = (t, block, t.folded.tobytes(), np.append(t.first, len(t.row)), np.append(block.tokens.first, len(block.words)), block.settings)
    for g in np.unique(group[per_row > 0]):
        pairs: dict[tuple[int, int], list[tuple[int, int, str]]] = defaultdict(list)
        special: dict[tuple[int, int], dict[int, list[tuple[int, int, str]]]] = defaultdict(lambda: defaultdict(list))
        for name, side, place, row, lo, n in found:
            own = group[row] == g
            here = np.repeat(np.flatnonzero(own), n[own])
            there = np.repeat(lo[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(len(here))
            for d, i, r, k, x in zip(place[here].tolist(), side.at[there].tolist(), row[here].tolist(), side.row[there].tolist(), side.own[there].tolist(), strict=True):
                first = int(block.first[k])
                if x and first in block.members:
                    special[r, first][k].append((d, i, name))
                else:
                    pairs[r, first].append((d, i, name))
        for r, first in sorted({*pairs, *special}):
            for k, best in _of_members(pairs.get((r, first), []), special.get((r, first), {}), first, *rest):
                start = int(texts.start[r])
                yield r, k, *best[:3], _named(best[3]), best[4] - start, min(best[5], int(texts.end[r])) - start


def _of_members(shared: list[tuple[int, int, str]], special: dict[int, list[tuple[int, int, str]]], first: int, t: Tokens, block: Block, *rest) -> Iterator[tuple[int, tuple]]:
    """Items alike with their verdicts: those with windows of their own one by one, all others by one verdict on what they share."""
    members = block.members.get(first, [first])
    for k, windows in special.items():
        shift = {"literal": int(block.literal_at[k] - block.literal_at[first]), "template": int(block.template_at[k] - block.template_at[first])}
        best = _judge(windows + [(d, i + shift[name], name) for d, i, name in shared], k, t, block, *rest)
        if best:
            yield k, best
    others = [k for k in members if k not in special]
    best = _judge(shared, first, t, block, *rest) if shared and others else None
    if not best:
        return
    at = {block.value(j): j - int(block.template_at[first]) for j in range(int(block.template_at[first]), int(block.template_at[first + 1])) if best[3] and block.tokens.slot[j]}
    for k in others:
        slots = {block.value(int(block.template_at[k]) + at[x]): y for x, y in best[3].items()} if k != first else best[3]
        kind = best[2] if best[2] == "literal" else "reparameterised" if any(x != y for x, y in slots.items()) else "template"
        yield k, (*best[:2], kind, slots, *best[4:])


def _named(slots: dict[bytes, bytes]) -> str:
    return ";".join(f"{x.decode('utf-8', 'replace')}={y.decode('utf-8', 'replace')}" for x, y in sorted(slots.items()) if x != y)


def _judge(found: list[tuple[int, int, str]], k: int, t: Tokens, block: Block, *rest) -> tuple | None:
    """The best verdict on the pairs of windows of one text and item k."""
    best = None
    for verdict in _verdicts(found, k, t, block, *rest):
        if verdict and (best is None or verdict[0] > best[0]):
            best = verdict
            if best[0] >= 1:  # all windows of the item: none is better, the first counts
                break
    return best


def _verdicts(found: list[tuple[int, int, str]], k: int, t: Tokens, block: Block, *rest) -> Iterator[tuple | None]:
    """Of the literal windows; of all template windows as one candidate; where their slots disagree, of each place where a copy may lie alone."""
    shapes = {x: (int(block.sides[x].n_windows[k]), int(block.sides[x].width[k])) for x in block.sides}
    yield _verdict(sorted({(d, i) for d, i, x in found if x == "literal"}), "literal", shapes["literal"], t, block, *rest)
    own = [(d, i) for d, i, x in found if x == "template"]
    if not own:
        return
    # Literal hits count as template windows too, at their template places.
    own += [(int(np.searchsorted(t.first, d, side="right")) - 1, int(np.searchsorted(block.tokens.first, i, side="right")) - 1) for d, i, x in found if x == "literal"]
    shape = shapes["template"]
    whole = _verdict(sorted(set(_consistent(own, shape[1], t, block, *rest))), "template", shape, t, block, *rest)
    yield whole
    if whole is None:
        for place in _places(sorted(set(own)), shape, block.settings):
            yield _verdict(sorted(_consistent(place, shape[1], t, block, *rest)), "template", shape, t, block, *rest)


def _verdict(own: list[tuple[int, int]], side: str, shape: tuple[int, int], t: Tokens, block: Block, raw: bytes, doc_first: np.ndarray, item_first: np.ndarray, s: LeakSettings) -> tuple | None:
    """coverage, run, kind, mapping of slots' values, start and end in the slice, if these windows are a leak."""
    if not own:
        return None
    total, width = shape
    reach = 2 * (total + width)
    lo, counts, top = 0, defaultdict(int), (0, 0, 0)
    for d, i in own:
        counts[i] += 1
        while own[lo][0] < d - reach:
            counts[own[lo][1]] -= 1
            if not counts[own[lo][1]]:
                del counts[own[lo][1]]
            lo += 1
        if len(counts) > top[0]:
            top = (len(counts), own[lo][0], d)
    diagonal: dict[int, list[int]] = defaultdict(list)
    for d, i in own:
        diagonal[d - i].append(d)
    run = 0
    for ds in diagonal.values():
        length = 0
        for a, b in zip([None, *ds], ds, strict=False):
            length = length + 1 if a is not None and b == a + 1 else 1
            run = max(run, length)
    run_tokens = run + width - 1
    share = top[0] / total
    if share < s.coverage and run_tokens < s.run_tokens:
        return None
    if side == "literal":
        a, b = t.start[top[1]], t.end[min(top[2] + width, len(t.row)) - 1]
    else:
        a, b = t.start[doc_first[top[1]]], t.end[doc_first[min(top[2] + width, len(t.first))] - 1]
    slots = _mapping(own, width, t, block, raw, doc_first, item_first, s) if side == "template" else {}
    return share, run_tokens, "reparameterised" if any(x != y for x, y in slots.items()) else side, slots, int(a), int(b)


def _places(own: list[tuple[int, int]], shape: tuple[int, int], s: LeakSettings) -> Iterator[list[tuple[int, int]]]:
    """The windows of each place where one copy of the item may lie: of one diagonal, of near diagonals, of a stretch as long as the item.

    Places with too few windows for a leak are left out.
    """
    total, width = shape
    length = total + width - 1
    slack = length // 4
    enough = min(s.coverage * total, s.run_tokens - width + 1)
    shifts = sorted((d - i, d, i) for d, i in own)
    by_shift, by_start = [g for g, _, _ in shifts], [d for d, _ in own]
    spans = {(bisect_left(by_shift, g - x), bisect_right(by_shift, g + x)) for g in set(by_shift) for x in (0, slack)}
    for lo, hi in sorted(spans):
        if len({i for _, _, i in shifts[lo:hi]}) >= enough:
            yield sorted((d, i) for _, d, i in shifts[lo:hi])
    last = 0
    for d in sorted(set(by_start)):
        lo, hi = bisect_left(by_start, d), bisect_left(by_start, d + length + slack)
        if hi > last and len({i for _, i in own[lo:hi]}) >= enough:
            yield own[lo:hi]
        last = hi


def _slot_values(d: int, i: int, width: int, t: Tokens, block: Block, raw: bytes, doc_first: np.ndarray, item_first: np.ndarray, s: LeakSettings) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of benchmark value and document value of the slots of a pair of windows."""
    for a, b in zip(range(d, min(d + width, len(t.slot))), range(i, min(i + width, len(block.tokens.slot))), strict=False):
        if t.slot[a] and block.tokens.slot[b]:
            yield b" ".join(block.words[item_first[b] : item_first[b + 1]]), raw[t.start[doc_first[a]] : t.end[doc_first[a + 1] - 1]]


def _mapping(own: list[tuple[int, int]], *rest) -> dict[bytes, bytes]:
    """A one-to-one mapping of benchmark values to document values: pairs with most votes first, then by value."""
    votes: dict[tuple[bytes, bytes], int] = defaultdict(int)
    for d, i in own:
        for pair in _slot_values(d, i, *rest):
            votes[pair] += 1
    mapping: dict[bytes, bytes] = {}
    taken: set[bytes] = set()
    for x, y in sorted(votes, key=lambda pair: (-votes[pair], pair)):
        if x not in mapping and y not in taken:
            mapping[x] = y
            taken.add(y)
    return mapping


def _consistent(own: list[tuple[int, int]], *rest) -> list[tuple[int, int]]:
    """The windows whose slots agree with the pair's mapping of values; none if too few do."""
    mapping = _mapping(own, *rest)
    good = [(d, i) for d, i in own if all(mapping.get(x) == y for x, y in _slot_values(d, i, *rest))]
    return good if len(good) >= rest[-1].slot_agreement * len(own) else []


# --- the benchmark in the shared folder -----------------------------------------------------


def write_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Write the items with a text to the shared folder; the files, whose number does not depend on documents."""
    spark = benchmark.sparkSession
    path = fresh_path(spark, "benchmark")
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    items.write.option("compression", "zstd").parquet(path)
    return sorted(spark.read.schema("item_id long, text string").parquet(path).inputFiles())


class Items:
    """The benchmark as blocks of bounded items and bytes; the first of them, up to ``keep_bytes``, stay in memory."""

    def __init__(self, files: list[str], settings: LeakSettings):
        self.files, self.settings = files, settings
        self.kept: list[Block] = []
        self.complete = False  # does ``kept`` hold all blocks
        self.full = False

    def blocks(self) -> Iterator[Block]:
        yield from list(self.kept)
        if self.complete:
            return
        skip = len(self.kept)
        for k, items in enumerate(self._pieces()):
            if k < skip:
                continue
            block = Block(items, self.settings)
            self.full = self.full or sum(b.nbytes for b in self.kept) + block.nbytes > self.settings.keep_bytes
            if not self.full:
                self.kept.append(block)
            yield block
        self.complete = not self.full

    def _pieces(self) -> Iterator[list[tuple[int, str]]]:
        waiting: list[tuple[int, str]] = []
        size = 0
        for file in self.files:
            filesystem, path = pafs.FileSystem.from_uri(file)
            with filesystem.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(1024):
                    for item_id, text in zip(column(batch, "item_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                        if waiting and (len(waiting) == self.settings.block_items or size + len(text) > self.settings.block_bytes):
                            yield waiting
                            waiting, size = [], 0
                        waiting.append((item_id, text))
                        size += len(text)
        if waiting:
            yield waiting


_open: dict[tuple[str, ...], Items] = {}
KEPT["decontam"] = _open.clear


def _items_of(files: list[str], settings: LeakSettings) -> Items:
    """The worker's view of a benchmark; one at a time."""
    key = tuple(files)
    if key not in _open or _open[key].settings != settings:
        _open.clear()
        _open[key] = Items(files, settings)
    return _open[key]


def _matches(batches: Iterator[pa.RecordBatch], text_name: str, files: list[str], settings: LeakSettings) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each slice of the batches with its leaks: row, item id, and what ``_judge`` found.

    While the blocks fit in memory a window is one slice; else blocks are read once for many.
    """
    items = _items_of(files, settings)
    for _ in items.blocks():  # keeps what fits
        if items.full:
            break
    window: list[pa.RecordBatch] = []
    size = 0

    def judged() -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        leaks: list[list[tuple]] = [[] for _ in window]
        for block in items.blocks():
            for part, own in zip(window, leaks, strict=True):
                own += [(r, block.ids[k], *rest) for r, k, *rest in _leaks(Texts(column(part, text_name)), block)]
        yield from zip(window, leaks, strict=True)

    for part in slices(batches, text_name):
        window.append(part)
        size += column(part, text_name).nbytes
        if items.complete or size >= settings.window_bytes:
            yield from judged()
            window, size = [], 0
    if window:
        yield from judged()


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each leaked benchmark item in each document."""
    settings = settings or LeakSettings()
    ship(docs.sparkSession)
    files = write_items(benchmark, item_col, item_text_col)
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, leaks in _matches(batches, "text", files, settings):
            ids = column(part, "doc_id").to_pylist()
            if leaks:
                columns = zip(*((ids[r], *rest) for r, *rest in leaks), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "coverage", "run_tokens", "kind", "slots", "start_byte", "end_byte"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA, "decontam")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns."""
    settings = settings or LeakSettings()
    ship(docs.sparkSession)
    files = write_items(benchmark, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, leaks in _matches(batches, text_col, files, settings):
            clean = np.ones(part.num_rows, bool)
            clean[[r for r, *_ in leaks]] = False
            yield part.filter(pa.array(clean))

    return map_batches(docs, run, docs.schema, "decontam")
