"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over whole Arrow
slices, give the share of a text's word characters that lie inside n-grams found twice
or more in it (first occurrences included, overlaps counted once), and inside
lines equal to an earlier one. The limits are the published ones of the MassiveText
corpus (Rae et al. 2021, table A1); none is fitted to the data at hand. Map-only:
no shuffle, memory bounded by a slice of about 0.5 MB of text (or one longer
document).

Defined cases: a null text has no words and one empty line; a document without
words fails the base rule; repeated rows are judged one by one; an empty table
gives no rows. Columns of the input other than the id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import Texts, column, covered, map_batches, repeated, slices, span_hash, windows
from sheafline.session import ship

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares: of word characters inside repeated n-grams, of lines that repeat, of word characters in these."""

    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_share: float = 0.30
    line_char_share: float = 0.20
    min_words: int = 10
    repeat_percent: int = 20


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_char_share double, dup_ngram_char_share double, verdict string"


def measure(texts: Texts, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but for doc_id, for every row of ``texts``."""
    n = texts.n
    data = texts.data
    s, e, row = texts.words()
    prefix = texts.prefix()
    n_words = np.bincount(row, minlength=n)
    is_char = (data & 0xC0) != 0x80
    chars_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_char, out=chars_before[1:])
    chars = chars_before[e] - chars_before[s]
    word_chars = np.bincount(row, weights=chars, minlength=n).astype(np.int64)
    hashes = span_hash(prefix, s, e)

    ls, le, lrow = texts.lines()
    words_before = np.searchsorted(s, np.stack([ls, le]))
    used = words_before[1] > words_before[0]
    ls, le, lrow, words_before = ls[used], le[used], lrow[used], words_before[:, used]
    _, later = repeated(span_hash(prefix, ls, le), lrow)
    n_lines = np.bincount(lrow, minlength=n)
    n_dup_lines = np.bincount(lrow[later], minlength=n)
    chars_upto = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=chars_upto[1:])
    line_chars = chars_upto[words_before[1]] - chars_upto[words_before[0]]
    dup_line_chars = np.bincount(lrow[later], weights=line_chars[later], minlength=n)

    safe_chars = np.maximum(word_chars, 1)
    over = np.zeros(n, bool)
    worst = np.zeros(n)
    n_repeat = np.zeros(n, np.int64)
    candidates = None
    for length in sorted({5, *rules.ngram_share}):
        keys, at = windows(hashes, row, length)
        if candidates is not None:  # a repeated n-gram begins with a repeated shorter one
            inside = candidates[at]
            keys, at = keys[inside], at[inside]
        many, _ = repeated(keys, row[at])
        at = at[many]
        if length >= 5:
            candidates = np.zeros(len(hashes), bool)
            candidates[at] = True
        hit = covered(at, length, len(hashes))
        if length == 5:
            n_repeat = np.bincount(row[hit], minlength=n)
        share = np.bincount(row[hit], weights=chars[hit], minlength=n) / safe_chars
        limit = rules.ngram_share.get(length)
        if limit is not None:
            over |= share > limit
            worst = np.maximum(worst, share)
    line_char_share = dup_line_chars / safe_chars
    over_lines = (n_dup_lines / np.maximum(n_lines, 1) > rules.line_share) | (line_char_share > rules.line_char_share)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    verdict = np.select([base_failed, over, over_lines], ["base", "ngrams", "lines"], "kept")
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": texts.per_row(SYMBOLS[data] & True),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~(base_failed | over | over_lines),
        "dup_line_char_share": line_char_share,
        "dup_ngram_char_share": worst,
        "verdict": verdict,
    }


def repetition_quality(docs: DataFrame, rules: RepetitionRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its repetition measures and verdict."""
    rules = rules or RepetitionRules()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = measure(Texts(column(part, "text")), rules)
            arrays = [column(part, "doc_id"), *(pa.array(v if v.dtype.kind in "bfU" else v.astype(np.int64)) for v in found.values())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *found])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA, "repetition")
