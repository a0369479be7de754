"""Language ID by multilingual mixture inference.

Training counts hashed byte 4-grams per language over labelled documents
(DataFrame aggregation, map-side combined). A document is cut into short
segments; expectation-maximisation over their n-gram likelihoods estimates its
language proportions. The language set is chosen by penalised likelihood:
starting from all languages, the one with the least share is removed, the
mixture fitted anew, and each document keeps the set with the smallest
BIC. Inference is map-only and runs on all documents of a slice at once.

How far a document is in any learned language at all is its ``known`` share: the
part of its segments, and of one more in its favour, that the best language explains
better than noise, that is, n-grams drawn evenly from all buckets.

Training uses every labelled row up to ``train_rows`` per language; beyond that
a hash-chosen share of the rows of that language, so that the model is fitted on
a bounded sample. The most frequent ``most_langs`` languages are learned. The model
(languages x buckets) is the only broadcast; its size has these bounds and does not
depend on the number of documents.

Defined cases: null text or a text without a letter (category L) gives ``und`` with
score 0 and known share 0; a text with a letter but no n-gram of two letters gets the
training rows' shares and known share 1, as nothing speaks against it;
without any labelled row every document is ``und``; ties go to the first
language in alphabetical order; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import LOWER, Texts, column, map_batches, slices
from sheafline.session import ship

SCHEMA = "doc_id long, lang_pred string, score double, langs array<string>, proportions array<double>, known double"
_LETTER = regex.compile(r"\p{L}")
_FOLD = LOWER.copy()
_FOLD[:128] = np.where((LOWER[:128] >= 97) & (LOWER[:128] <= 122), LOWER[:128], 32)
_IS_LETTER = (_FOLD != 32).astype(np.uint8)


@dataclass(frozen=True)
class MixtureSettings:
    buckets_log2: int = 16
    train_rows: int = 40_000  # of each language
    segment_bytes: int = 48
    smoothing: float = 0.5
    temper: float = 0.25  # 4-grams overlap: each byte is in four of them
    rounds: int = 8
    penalty: float = 1.0  # BIC's factor
    most_langs: int = 256
    least_known: float = 0.5  # of a document that stays, see known_language_only


@dataclass
class MixtureModel:
    langs: list[str]
    log_p: np.ndarray  # buckets x languages, float32
    share: np.ndarray  # of each language among the labelled rows
    settings: MixtureSettings


def grams(data: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of the 4-gram at each byte; -1 where it holds under two letter bytes. Longer by no end: the last three have none."""
    if len(data) < 4:
        return np.full(len(data), -1, np.int32)
    b = _FOLD[data].astype(np.uint32)
    letters = _IS_LETTER[data]
    key = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    key *= np.uint32(0x9E3779B1)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA77)
    out = np.full(len(data), -1, np.int32)
    out[:-3] = key >> np.uint32(32 - bits)
    out[:-3][letters[:-3] + letters[1:-2] + letters[2:-1] + letters[3:] < 2] = -1
    return out


def _inner(texts: Texts, gram: np.ndarray) -> np.ndarray:
    """Without the grams that reach into the next row's text."""
    for k in (1, 2, 3):
        at = texts.end - k
        gram[at[at >= texts.start]] = -1
    return gram


def train(docs: DataFrame, settings: MixtureSettings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> MixtureModel:
    """Fit on the rows given; leave out held-out rows before."""
    s = settings or MixtureSettings()
    ship(docs.sparkSession)
    size = 1 << s.buckets_log2
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # The most frequent languages, a bounded number of rows.
    rows = labelled.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(s.most_langs).collect()
    langs = sorted(r["lang"] for r in rows)
    if not langs:
        return MixtureModel([], np.zeros((size, 0), np.float32), np.zeros(0), s)
    # A share of 2**20 hash values for each language: all of them up to the bound.
    share = F.create_map(*[F.lit(x) for r in rows for x in (r["lang"], min(1 << 20, (s.train_rows << 20) // r["count"] + 1))])
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 20))
    picked = labelled.filter(bucket < share[F.col(lang_col).cast("string")]).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    index = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), size), np.int64)
        for part in slices(batches, "text"):
            texts = Texts(column(part, "text"))
            gram = _inner(texts, grams(texts.data, s.buckets_log2))
            lang = np.array([index[x] for x in column(part, "lang").to_pylist()])
            of_byte = np.repeat(lang, texts.end - texts.start)
            used = gram >= 0
            total += np.bincount(of_byte[used] * size + gram[used], minlength=total.size).reshape(total.shape)
        for k in range(len(langs)):
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k][at])], ["lang", "bucket", "n"])

    counts = map_batches(picked, count, "lang int, bucket int, n long", "langmix").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most languages x buckets rows
    table = np.full((size, len(langs)), s.smoothing)
    table[found["bucket"], found["lang"]] += found["n"]
    number = {r["lang"]: r["count"] for r in rows}
    share = np.array([number[x] for x in langs], float)
    return MixtureModel(langs, np.log(table / table.sum(axis=0)).astype(np.float32), share / share.sum(), s)


def _fit(ll: np.ndarray, doc: np.ndarray, begin: np.ndarray, n_seg: np.ndarray, active: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document's mixture over its active languages."""
    pi = active / active.sum(axis=1, keepdims=True)
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)
    for _ in range(rounds):
        part = like * pi[doc]
        total = part.sum(axis=1, keepdims=True) + 1e-30
        pi = np.add.reduceat(part / total, begin, axis=0) / n_seg[:, None]
    evidence = np.log((like * pi[doc]).sum(axis=1) + 1e-30) + top[:, 0]
    return pi, np.add.reduceat(evidence, begin)


def _segment_scores(gram: np.ndarray, begin: np.ndarray, model: MixtureModel) -> np.ndarray:
    """Log-likelihood of each segment (from ``begin`` on) in each language, a bounded number of n-grams at a time."""
    most = max(1, (1 << 24) // len(model.langs))
    ends = np.append(begin, len(gram))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(gram), most)), len(begin)))
    return np.concatenate([np.add.reduceat(model.log_p[gram[ends[a] : ends[b]]], begin[a:b] - ends[a], axis=0) for a, b in zip(cuts, cuts[1:], strict=False)]).astype(np.float64)


def infer(texts: Texts, model: MixtureModel) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions (rows x languages), a row of zeros where no n-gram counts; known shares, 1 there."""
    s, n_langs = model.settings, len(model.langs)
    out, known = np.zeros((texts.n, n_langs)), np.ones(texts.n)
    if not n_langs or not len(texts.data):
        return out, known
    gram = _inner(texts, grams(texts.data, s.buckets_log2))
    length = texts.end - texts.start
    seg_of_row = -(-length // s.segment_bytes)
    first = np.concatenate([[0], np.cumsum(seg_of_row)])
    row = np.repeat(np.arange(texts.n), length)
    segment = first[row] + (np.arange(len(texts.data)) - texts.start[row]) // s.segment_bytes
    used = gram >= 0
    gram, segment = gram[used], segment[used]
    if not len(gram):
        return out, known
    begin = np.flatnonzero(np.diff(segment, prepend=-1))
    ll = _segment_scores(gram, begin, model)
    noise = -np.log(len(model.log_p)) * np.diff(np.append(begin, len(gram)))
    explained = ll.max(axis=1) >= noise
    ll *= s.temper
    row_of = np.searchsorted(first, segment[begin], side="right") - 1
    row_begin = np.flatnonzero(np.diff(row_of, prepend=-1))
    rows = row_of[row_begin]
    n_seg = np.diff(np.append(row_begin, len(row_of)))
    known[rows] = (np.add.reduceat(explained.astype(float), row_begin) + 1) / (n_seg + 1)
    doc = np.repeat(np.arange(len(rows)), n_seg)
    active = np.ones((len(rows), n_langs))
    pi, evidence = _fit(ll, doc, row_begin, n_seg, active, s.rounds)
    cost = s.penalty * np.log(np.maximum(n_seg, 2))
    best_pi, best = pi, -2 * evidence + (n_langs - 1) * cost
    for left in range(n_langs - 1, 0, -1):
        active[np.arange(len(rows)), np.where(active > 0, pi, 2).argmin(axis=1)] = 0
        pi, evidence = _fit(ll, doc, row_begin, n_seg, active, s.rounds if left > 1 else 0)
        bic = -2 * evidence + (left - 1) * cost
        better = bic < best
        best_pi, best = np.where(better[:, None], pi, best_pi), np.minimum(bic, best)
    out[rows] = best_pi
    return out, known


def _has_letter(text: pa.Array) -> np.ndarray:
    return np.array([t is not None and _LETTER.search(t) is not None for t in text.to_pylist()], bool)


def predict(text: pa.Array, m: MixtureModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the main language (that after the last: none), its share, all shares, has the text a letter, its known share."""
    pi, known = infer(Texts(text), m)
    has_letter = _has_letter(text)
    pi = np.where(pi.sum(axis=1, keepdims=True) > 0, pi, m.share)  # no n-gram counts: what the training rows say
    best = pi.argmax(axis=1) if pi.shape[1] else np.zeros(len(pi), int)
    score = np.clip(pi[np.arange(len(pi)), best], 0, 1) if pi.shape[1] else np.zeros(len(pi))
    return np.where(has_letter, best, len(m.langs)), np.where(has_letter, score, 0.0), pi, has_letter, np.where(has_letter, known, 0.0)


def language_mixture(docs: DataFrame, model: MixtureModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: main language, its share, and the whole mixture."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for part in slices(batches, "text", 1 << 20):
            best, score, pi, has_letter, known = predict(column(part, "text"), m)
            kept = [np.flatnonzero(p > 0.005) if ok else [] for p, ok in zip(pi, has_letter, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array([[m.langs[k] for k in ks] for ks in kept], pa.list_(pa.string())), pa.array([[float(p[k]) for k in ks] for p, ks in zip(pi, kept, strict=True)], pa.list_(pa.float64())), pa.array(known)],
                ["doc_id", "lang_pred", "score", "langs", "proportions", "known"],
            )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA, "langmix")


def known_language_only(docs: DataFrame, model: MixtureModel, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are in learned languages.

    Those go that have no letter (or text), and those of which the model's languages explain
    under ``least_known`` of the segments better than noise. Without a learned language
    all documents with a letter stay. Rows are judged one by one, so repeated rows are judged alike.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, text_col):
            if m.langs:
                best, _, _, _, known = predict(column(part, text_col), m)
                keep = (best < len(m.langs)) & (known >= m.settings.least_known)
            else:
                keep = _has_letter(column(part, text_col))
            yield part.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema, "langmix")


def held_out(id_col: str = "doc_id") -> Column:
    """The split of the query's contract."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
