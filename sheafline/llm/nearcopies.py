"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates share one of 20 bands of five MinHash values; every candidate pair
is then checked on the shingles themselves, so no text is taken for a copy that
isn't one. A pair at just 0.8 shares no band with probability 0.0004, less above.

Equal sets are first reduced to one. In each band's bucket all sets are checked
against its hub, the set that shares most buckets with most sets: among edited copies
of one text that is the text, or the copy nearest to it. Then those outside the hub's
component are compared with the whole bucket, unless both are in one component
already. So a large group of near copies costs about a pair a member, and nothing is
capped. Of the remaining pairs only those go on to the check whose sizes, and 1024
bits of MinHash values, allow for the similarity (the bits err for a pair at just 0.8
with a probability of about 10**-5); comparing them is quadratic in the number of
sets in a bucket that are no near copies of its hub.

Defined cases: words and case as in the SimHash of the same texts; under
``shingle`` words the whole sequence is the one shingle; texts without words,
null texts and rows without an id are in no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import BASE, LOWER, Texts, column, map_batches, mix, slices, span_hash, windows
from sheafline.llm.components import components
from sheafline.llm.simhash import fingerprints
from sheafline.session import ship, staged

U64 = np.uint64
SHINGLE, BANDS, ROWS, FINE = 5, 20, 5, 1024
#: Jaccard similarity of near copies, as a fraction.
OVER, UNDER = 4, 5
#: At a similarity of 0.8, 1024 bits (one of each value) differ in 102.4 bits, standard deviation 9.6.
BITS_APART = 144
#: Up to so many ids (8 bytes each, so 16 MB) go to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(20240301)
_XOR, _FACTOR = _rng.integers(0, 2**64, FINE, dtype=np.uint64), _rng.integers(0, 2**63, FINE, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, sorted by both."""
    s, e, row = texts.words()
    values = span_hash(texts.prefix(LOWER[texts.data]), s, e)
    hashes, at = windows(values, row, shingle)
    owner = row[at]
    size = np.bincount(row, minlength=texts.n)
    short = np.flatnonzero((size > 0) & (size < shingle))
    if len(short):
        begin, whole = np.searchsorted(row, short), np.zeros(len(short), U64)
        for k in range(shingle - 1):
            longer = size[short] > k
            whole[longer] = whole[longer] * U64(BASE) + values[begin[longer] + k]
        hashes, owner = np.concatenate([hashes, mix(whole + size[short].astype(U64))]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new]


def _least(hashes: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """The k-th MinHash value of each set of hashes."""
    return mix(np.minimum.reduceat((hashes ^ _XOR[k]) * _FACTOR[k], begin))


def sketches(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row with shingles: row, key of the set, its size, where its hashes begin, a key for each band."""
    rows, begin = np.unique(owner, return_index=True)
    size = np.diff(np.append(begin, len(owner)))
    if not len(rows):
        return rows, np.zeros(0, U64), size, begin, np.zeros((0, BANDS), U64)
    keys = mix(np.add.reduceat(mix(hashes ^ U64(0x5E75)), begin) + size.astype(U64))
    bands = np.zeros((len(rows), BANDS), U64)
    for band in range(BANDS):
        for k in range(ROWS):
            bands[:, band] = bands[:, band] * U64(BASE) + _least(hashes, begin, band * ROWS + k)
    return rows, keys, size, begin, mix(bands + mix(np.arange(BANDS, dtype=U64)))


def fine_bits(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """16 words of bits of each set, one bit of each MinHash value."""
    bits = np.empty((len(begin), FINE), np.uint8)
    for k in range(FINE):
        bits[:, k] = _least(hashes, begin, k) >> U64(63)
    return np.packbits(bits, axis=1).view(U64)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (SimHash) of every row; set_key, size, bands of those with words, else null or empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text = column(part, "text")
            prints = fingerprints(text.to_pylist())
            rows, keys, size, _, bands = sketches(*shingle_sets(Texts(text)))
            none = np.ones(part.num_rows, bool)
            none[rows] = False
            every = [np.zeros((part.num_rows, *x.shape[1:]), x.dtype) for x in (keys, size, bands)]
            for whole, x in zip(every, (keys, size, bands), strict=True):
                whole[rows] = x
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(prints.view(np.int64)), pa.array(every[0].view(np.int64), mask=none), pa.array(every[1].astype(np.int64)), _lists(every[2])], ["doc_id", "fp", "set_key", "size", "bands"]
            )

    return map_batches(_plain(docs, id_col, text_col), run, "doc_id long, fp long, set_key long, size long, bands array<long>", "nearcopies")


def _shingles_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set_key, fp, size, bits, shingles (32 bits each, sorted) of the wanted sets (doc, set_key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, hashes = shingle_sets(Texts(column(part, "text")))
            rows, keys, size, begin, _ = sketches(owner, hashes)
            if not len(rows):
                continue
            ends = np.append(begin, len(hashes)).astype(np.int32)
            # The hashes are sorted, so are their upper halves.
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(size.astype(np.int64)), _lists(fine_bits(hashes, begin)), pa.ListArray.from_arrays(pa.array(ends), pa.array((hashes >> U64(32)).astype(np.uint32).view(np.int32)))], ["set_key", "size", "bits", "shingles"]
            )

    ids = wanted.select(F.col("doc").alias("doc_id"))
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = map_batches(_plain(docs, id_col, text_col).join(ids, "doc_id", "left_semi"), run, "set_key long, size long, bits array<long>, shingles array<int>", "nearcopies")
    return staged(texts.dropDuplicates(["set_key"]).join(wanted.select("set_key", "fp"), "set_key"), "shingles")


def _with(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Rows joined with the one row of ``side`` that has their key.

    Keys that a thousandth of the rows share, at most a thousand, are dealt over as many
    tasks as they have thousandths, and their row of ``side`` goes to each of these.
    """
    total = rows.count()
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(64, total // 1000))
    heavy = F.broadcast(heavy.select(key, F.ceil(F.col("n") * 1000 / max(total, 1)).cast("int").alias("parts")))
    other = [c for c in rows.columns if c != key]
    dealt = rows.join(heavy, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*other), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = side.join(heavy, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def _checked(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Of pairs u, v of sets those that are near copies, with their fingerprints fu, fv."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(column(batch, "a"), column(batch, "b"), strict=True)):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(x, y))
                near[k] = UNDER * both >= OVER * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("u", "v", "fu", "fv")], ["u", "v", "fu", "fv"]).filter(pa.array(near))

    first = shingles.select(F.col("set_key").alias("u"), F.col("fp").alias("fu"), F.col("shingles").alias("a"))
    other = shingles.select(F.col("set_key").alias("v"), F.col("fp").alias("fv"), F.col("shingles").alias("b"))
    pairs = staged(pairs, "pairs")
    return staged(map_batches(_with(pairs, first, "u").join(other, "v").select("u", "v", "fu", "fv", "a", "b"), run, "u long, v long, fu long, fv long", "nearcopies"), "near-pairs")


def _may_be_near(a: str, b: str):
    """Sizes and bits of two members allow for near copies."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(FINE // 64)), F.lit(0))
    return (UNDER * F.least(size_a, size_b) >= OVER * F.greatest(size_a, size_b)) & (apart <= BITS_APART)


def near_links(docs: DataFrame, seen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """u, v: fingerprints of texts that are near copies, or equal as sets; enough of them for all components."""
    ship(docs.sparkSession)
    known = seen.filter("set_key is not null and doc_id is not null")
    sets = staged(known.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min("fp").alias("fp"), F.max("fp").alias("other"), F.first("bands").alias("bands")), "sets")
    twins = known.select("set_key", F.col("fp").alias("v")).join(sets.filter("fp <> other").select("set_key", F.col("fp").alias("u")), "set_key").filter("u <> v").select("u", "v").distinct()

    bands = sets.select("set_key", F.explode("bands").alias("key"))
    crowded = staged(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")
    shared = staged(bands.join(crowded, "key"), "shared")
    weights = shared.groupBy("set_key").agg(F.sum("n").alias("weight"))
    # The hub of a bucket: the set with the largest buckets altogether, then the least key.
    hubs = staged(shared.join(weights, "set_key").groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("set_key").alias("low"))).alias("hub")).select("key", F.bitwise_not("hub.low").alias("low")), "hubs")
    members = staged(shared.select("key", "set_key").join(hubs, "key"), "members")
    info = staged(sets.join(members.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "doc", "fp"), "member-sets")
    shingles = _shingles_of(docs, info, id_col, text_col)

    sized = shingles.select("set_key", "size", "bits")
    star = staged(members.filter("set_key <> low").select("low", "set_key").distinct(), "star")
    hub = sized.select(F.col("set_key").alias("low"), F.struct("size", "bits").alias("x"))
    star = _with(star, hub, "low").join(sized.select("set_key", F.struct("size", "bits").alias("y")), "set_key")
    found = _checked(star.filter(_may_be_near("x", "y")).select(F.col("low").alias("u"), F.col("set_key").alias("v")), shingles)

    roots = staged(components(found.select("u", "v")), "set-roots")
    named = members.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    low = roots.select(F.col("node").alias("low"), F.col("root").alias("low_root"))
    named = named.join(low, "low", "left").withColumn("low_root", F.coalesce("low_root", "low"))
    outside = staged(named.filter("root <> low_root"), "outside")
    # Only buckets with two sets outside, or one beside members other than the least, have pairs left.
    left = named.join(outside.select("key").distinct(), "key", "left_semi").filter("set_key <> low")
    left = staged(left.join(sized, "set_key").select("key", "set_key", "root", "low_root", "size", "bits"), "left")
    a, b = left.filter("root <> low_root").alias("a"), left.alias("b").hint("merge")
    # Two sets outside meet twice; the pair is taken once.
    once = (F.col("a.set_key") < F.col("b.set_key")) | (F.col("b.root") == F.col("b.low_root"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & _may_be_near("a", "b"))
    pairs = pairs.select(F.least("a.set_key", "b.set_key").alias("u"), F.greatest("a.set_key", "b.set_key").alias("v")).distinct()
    more = _checked(pairs, shingles)
    near = found.union(more).select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    return near.union(twins)
