"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Votes are
aggregated to counts of vote patterns (at most 3**labellers, over all documents,
map-side combined); expectation-maximisation on these counts estimates the
class share and each labeller's accuracy. Posterior labels train a linear scorer
on hashed words, on a bounded sample of documents chosen by hash, about
``train_rows`` and about ``train_bytes`` of text, in one task, which stops at twice
either; its weights (``2**weight_bits``) are broadcast and score every document.

Defined cases: rows without an id, and rows alike in id and text, are drawn one by
one; null or word-less texts get bad votes from the length labeller,
no features, and the scorer's bias; repeated rows are judged alike; an empty
table gives no rows; if all posteriors agree the scorer still trains, towards that
class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import LOWER, Texts, column, covered, map_batches, repeated, slices, span_hash, windows
from sheafline.session import ship

U64 = np.uint64
SCHEMA = "doc_id long, weak_label double, score double, kept boolean, votes string"
#: Codes of the votes, also the place of a class in an array of accuracies.
BAD, GOOD, ABSTAIN = 0, 1, 2
LABELLERS = ("length", "word_length", "symbols", "capitals", "line_copies", "phrase_copies", "sentences", "digits", "variety")


@dataclass(frozen=True)
class WeakModel:
    """What was fitted: posterior of good by vote pattern, accuracy (P(right vote | voted, text bad or good)) by labeller, share of good, the scorer's weights."""

    posterior: dict[bytes, float]
    accuracy: dict[str, tuple[float, float]]
    share: float
    weights: np.ndarray


@dataclass(frozen=True)
class WeakSettings:
    train_rows: int = 20_000
    train_bytes: int = 1 << 26
    weight_bits: int = 17
    epochs: int = 4
    batch_rows: int = 128
    rate: float = 0.3
    decay: float = 1e-5
    em_rounds: int = 100
    keep_from: float = 0.5


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _DIGIT, _UPPER, _STOP = _mask("#*$%&|<>{}[]~^=\\@"), _mask("0123456789"), np.zeros(256, bool), _mask(".!?")
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 256)]] = True


def _vote(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)).astype(np.int8)


def votes_and_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (rows x labellers), word hashes, and their rows."""
    n, data = texts.n, texts.data
    s, e, row = texts.words()
    n_words = np.bincount(row, minlength=n)
    some = np.maximum(n_words, 1)
    hashes = span_hash(texts.prefix(LOWER[data]), s, e)
    letters = np.maximum(texts.per_row(_LETTER[data]), 1)
    size = np.maximum(texts.end - texts.start, 1)
    mean_length = np.bincount(row, weights=e - s, minlength=n) / some
    symbols = texts.per_row(_SYMBOL[data]) / some
    capitals = texts.per_row(_UPPER[data]) / letters
    digits = texts.per_row(_DIGIT[data]) / size
    ls, le, lrow = texts.lines()
    used = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le, lrow = ls[used], le[used], lrow[used]
    _, later = repeated(span_hash(texts.prefix(), ls, le), lrow)
    n_lines = np.bincount(lrow, minlength=n)
    line_copies = np.bincount(lrow[later], minlength=n) / np.maximum(n_lines, 1)
    keys, at = windows(hashes, row, 4)
    many, _ = repeated(keys, row[at])
    phrase_copies = np.bincount(row[covered(at[many], 4, len(hashes))], minlength=n) / some
    sentences = texts.per_row(_STOP[data]) / some
    _, again = repeated(hashes, row)
    variety = 1 - np.bincount(row[again], minlength=n) / some
    ok = n_words >= 10
    votes = np.stack(
        [
            _vote(n_words, n_words == 0, (n_words >= 40) & (n_words < 20_000)),
            _vote(mean_length, ok & ((mean_length < 2.5) | (mean_length > 11)), ok & (mean_length > 3) & (mean_length < 9)),
            _vote(symbols, symbols > 0.1, ok & (symbols < 0.03)),
            _vote(capitals, capitals > 0.3, ok & (capitals < 0.12)),
            _vote(line_copies, (line_copies > 0.3) & (n_lines >= 5), (n_lines >= 3) & (line_copies < 0.05)),
            _vote(phrase_copies, phrase_copies > np.where(n_words >= 60, 0.3, 0.6), (n_words >= 40) & (phrase_copies < 0.08)),
            _vote(sentences, ok & ((sentences < 0.01) | (sentences > 0.6)), ok & (sentences > 0.03) & (sentences < 0.35)),
            _vote(digits, digits > 0.12, ok & (digits < 0.03)),
            _vote(variety, ok & (variety < 0.15), (n_words >= 40) & (variety > 0.3)),
        ],
        axis=1,
    )
    return votes, hashes, row


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern; accuracies (labellers x 2: P(right vote | voted, text bad or good)); share of good.

    Bad texts are bad in different ways, each seen by few labellers, so one bad
    class would average over them and give the rarer ways to the good class. The
    model has the good class and one bad class per labeller, whose texts that
    labeller sees (so a text must have its bad vote); each class has its own
    chance of a bad vote for every labeller that votes, and abstaining says
    nothing. Expectation-maximisation starts from who votes bad.
    """
    n, k = patterns.shape
    one_hot = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)
    bad = patterns == BAD
    possible = np.concatenate([bad, np.ones((n, 1), bool)], axis=1)  # the last class is good
    resp = np.zeros((n, k + 1))
    resp[:, :k] = 0.96 * bad / np.maximum(bad.sum(1, keepdims=True), 1)
    resp[:, k] = 1 - resp[:, :k].sum(1)
    prior = np.tile(np.array([0.5, 1.0]), (k + 1, k, 1))
    prior[np.arange(k), np.arange(k)] = [20.0, 0.1]
    prior[k] = [0.05, 2.0]
    for _ in range(rounds):
        weight = resp * counts[:, None]
        seen = np.einsum("pc,plv->clv", weight, one_hot) + prior
        chance = seen / seen.sum(2, keepdims=True)
        share = (weight.sum(0) + 1) / (counts.sum() + k + 1)
        odds = np.where(possible, np.log(share) + np.einsum("plv,clv->pc", one_hot, np.log(chance)), -np.inf)
        new = np.exp(odds - odds.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - resp).max() < 1e-6
        resp = new
        if done:
            break
    good = resp[:, k]
    accuracy = np.full((k, 2), np.nan)
    for c, weight in ((BAD, (1 - good) * counts), (GOOD, good * counts)):
        right = (weight[:, None] * (patterns == c)).sum(0)
        voted = (weight[:, None] * (patterns != ABSTAIN)).sum(0)
        accuracy[:, c] = (right + 1) / (voted + 2)
    return good, accuracy, float((good * counts).sum() / max(counts.sum(), 1))


def _features(hashes: np.ndarray, row: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight index and value of each word; a text's values have squares adding up to about one."""
    return (hashes >> U64(64 - bits)).astype(np.int64), 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]


def _margin(weights: np.ndarray, index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return weights[-1] + np.bincount(row, weights=weights[index] * value, minlength=n)


def train_scorer(batches: Iterator[pa.RecordBatch], posterior_of: dict[bytes, float], s: WeakSettings) -> np.ndarray:
    """Logistic regression by mini-batches with per-weight step sizes; the last weight is the bias."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = size = 0
    for part in slices(batches, "text", 1 << 19):
        if rows >= 2 * s.train_rows or size >= 2 * s.train_bytes:
            break
        texts = Texts(column(part, "text"))
        rows, size = rows + texts.n, size + len(texts.data)
        votes, hashes, row = votes_and_words(texts)
        target = np.array([posterior_of.get(v.tobytes(), 0.5) for v in votes])
        index = (hashes >> U64(64 - s.weight_bits)).astype(np.int32)
        cuts = np.searchsorted(row, np.arange(0, texts.n + s.batch_rows, s.batch_rows))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            held.append((index[a:b], (row[a:b] - k * s.batch_rows).astype(np.int16), target[k * s.batch_rows : (k + 1) * s.batch_rows]))
    weights, seen = np.zeros((1 << s.weight_bits) + 1), np.full((1 << s.weight_bits) + 1, 1e-4)
    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in rng.permutation(len(held)):
            index, row, target = held[k]
            n = len(target)
            if not n:
                continue
            value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
            error = 1 / (1 + np.exp(-np.clip(_margin(weights, index, value, row, n), -30, 30))) - target
            gradient = np.bincount(index, weights=error[row] * value, minlength=len(weights)) / n
            gradient[-1] = error.mean()
            gradient += s.decay * weights
            seen += gradient**2
            weights -= s.rate * gradient / np.sqrt(seen)
    return weights


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, settings: WeakSettings | None = None, id_col: str = "doc_id", text_col: str = "text") -> WeakModel | None:
    """The label model over all documents and the scorer over the sample; None without documents."""
    s = settings or WeakSettings()
    source = _source(docs, id_col, text_col)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, list[int]] = {}
        for part in slices(batches, "text"):
            texts = Texts(column(part, "text"))
            votes, _, _ = votes_and_words(texts)
            kinds, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
            sizes = np.bincount(of.reshape(-1), weights=texts.end - texts.start, minlength=len(kinds))
            for kind, count, size in zip(kinds, counts, sizes, strict=True):
                have = total.setdefault(kind.tobytes(), [0, 0])
                have[0] += int(count)
                have[1] += int(size)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), *(pa.array([x[k] for x in total.values()], pa.int64()) for k in (0, 1))], ["pattern", "n", "bytes"])

    counted = map_batches(source.select("text"), patterns, "pattern binary, n long, bytes long", "weaklabel").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 3**labellers rows
    if not counted:
        return None
    counted.sort(key=lambda r: bytes(r["pattern"]))
    found = np.array([np.frombuffer(bytes(r["pattern"]), np.int8) for r in counted])
    counts = np.array([r["n"] for r in counted], float)
    posterior, accuracy, share = fit_labellers(found, counts, s.em_rounds)
    posterior_of = {p.tobytes(): float(x) for p, x in zip(found, posterior, strict=True)}

    part = min(1.0, s.train_rows / max(counts.sum(), 1), s.train_bytes / max(sum(r["bytes"] for r in counted), 1))
    # Rows alike in id and text differ in the last value, so that they are not all in or all out.
    draw = F.xxhash64("doc_id", "text", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    sample = source.withColumn("draw", draw).filter(F.pmod("draw", F.lit(1 << 30)) <= int(part * (1 << 30)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([train_scorer(batches, posterior_of, s).astype("<f4").tobytes()], pa.binary())], ["weights"])

    # One task holds the sample's word numbers. Sorted by draw, so that a repeated task trains alike and a cut falls on no kind of row.
    trained = map_batches(sample.repartition(1).sortWithinPartitions("draw").select("doc_id", "text"), learn, "weights binary", "weaklabel").first()
    weights = np.zeros((1 << s.weight_bits) + 1) if trained is None else np.frombuffer(bytes(trained["weights"]), "<f4").astype(float)
    return WeakModel(posterior_of, {name: (float(a), float(b)) for name, (a, b) in zip(LABELLERS, accuracy, strict=True)}, share, weights)


def apply(docs: DataFrame, model: WeakModel, settings: WeakSettings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: posterior of the votes, the scorer's score, and the verdict."""
    s = settings or WeakSettings()
    source = _source(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "text"):
            texts = Texts(column(part, "text"))
            votes, hashes, row = votes_and_words(texts)
            index, value = _features(hashes, row, texts.n, s.weight_bits)
            scores = 1 / (1 + np.exp(-np.clip(_margin(m.weights, index, value, row, texts.n), -30, 30)))
            weak = np.array([m.posterior.get(v.tobytes(), 0.5) for v in votes])
            letters = np.array(["b", "g", "-"])[votes]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(weak), pa.array(scores), pa.array(scores >= s.keep_from), pa.array(["".join(v) for v in letters], pa.string())], ["doc_id", "weak_label", "score", "kept", "votes"]
            )

    return map_batches(source, score, SCHEMA, "weaklabel")


def weak_quality(docs: DataFrame, settings: WeakSettings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the documents, then score each of them."""
    model = fit(docs, settings, id_col, text_col)
    return docs.sparkSession.createDataFrame([], SCHEMA) if model is None else apply(docs, model, settings, id_col, text_col)
