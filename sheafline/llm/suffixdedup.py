"""Substring dedup with blockwise suffix sorting over a difference cover.

Every byte covered by a ``length``-byte string that also starts in a document
with a smaller id is removed. Matches are exact and never cross documents.

All suffixes of a large corpus don't fit a shuffle, so candidates come first.
Each window of ``length`` bytes has one anchor, the leftmost least hash of its
``gram``-byte grams; equal windows have equal anchors at equal distances. Windows
of one anchor lie side by side and form a context of at most 2 * length - gram bytes.

1. Texts are written once as chunks of about 4 MB in the shared folder. Whole
   copies of a smaller id's text are found by their digests and need no more work.
2. Each chunk's distinct anchor hashes go to hash buckets (nine bytes each), and
   their states come back by chunk: alone in one document, shared, or heavy.
3. Contexts of shared anchors go to their anchor's partition: once for some chunks of
   a task (up to ``held_bytes`` of contexts), with the least id that holds them there,
   and one row of numbers for each further chunk. Those of heavy anchors are cut by the
   distance to the anchor and go by the bytes around it, so that the contexts at the
   ends of a passage in a third of all documents make no large group.
4. There, blocks of contexts are suffix-sorted, all of them: a difference cover
   modulo 13 (0, 1, 3, 9) is sampled; the sampled suffixes are ranked by their first 13
   bytes, then by doubling, as 13 bytes on lies the next sample of the same residue;
   and then one bucket of window suffixes (those of one residue) is sorted at a
   time: by the few bytes before the next cover position, ties by that position's rank.
   Runs of equal windows get their least document id. Memory is bounded by the block:
   rows of numbers come after the contexts of their anchor and only pass through.
5. What each chunk has to remove comes back by chunk and is applied there.

Texts are never shuffled; tasks read their own chunk's states from the shared
folder, where a bounded number of parts hold the rows of many chunks, in order.
Lost executors cost only their running tasks.

Defined cases: a null text is empty; documents with equal ids do not take bytes
from one another; a null id counts as larger than any other; repeated rows give
repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import BASE_INVERSE, KEPT, Texts, column, map_batches, mix, powers, slices, span_hash
from sheafline.session import fresh_path, ship, staged

U64 = np.uint64
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
NO_ID = 2**63 - 1
#: A difference cover modulo 13: every difference of two residues occurs; the next cover place is at most 5 away.
MODULUS, COVER = 13, (0, 1, 3, 9)
_TO_COVER = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)])


@dataclass(frozen=True)
class SuffixSettings:
    length: int = 50
    gram: int = 20
    chunk_bytes: int = 1 << 22
    bucket_samples: int = 1 << 20
    heavy_from: int = 128  # contexts of an anchor, added up over chunks; only how work is dealt depends on it
    heavy_distances: int = 4
    block_bytes: int = 1 << 22
    held_bytes: int = 1 << 24
    reducer_bytes: int = 1 << 26
    most_parts: int = 16_384  # folders of chunks' rows, and reducers of anchors' buckets


# --- anchors --------------------------------------------------------------------------------


def _pieces(texts: Texts, most: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of some whole rows, or of parts of a long row that overlap so that each window is in one."""
    at = 0
    while at < texts.n:
        a = int(texts.start[at])
        upto = max(at + 1, int(np.searchsorted(texts.end, a + most, side="right")))
        b = int(texts.end[upto - 1])
        if upto == at + 1 and b - a > most:
            for x in range(a, max(b - length + 1, a + 1), most):
                yield x, min(x + most + length - 1, b)
        elif b > a:
            yield a, b
        at = upto


@dataclass
class Runs:
    """Runs of windows of one anchor: its hash and place, the first window, their number, the row, a hash of the bytes."""

    anchor: np.ndarray
    place: np.ndarray
    first: np.ndarray
    count: np.ndarray
    row: np.ndarray
    content: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(getattr(self, x)[which] for x in self.__dataclass_fields__))


def _content(prefix: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    return span_hash(prefix, first, first + count + length - 1) if len(first) else np.zeros(0, U64)


def runs_of(texts: Texts, skip: np.ndarray, s: SuffixSettings) -> Runs:
    """All runs of the rows that are not skipped."""
    out: list[Runs] = []
    width = s.length - s.gram + 1
    row_of = np.repeat(np.arange(texts.n, dtype=np.int32), texts.end - texts.start)
    for a, b in _pieces(texts, 1 << 18, s.length):
        data = texts.data[a:b]
        m = len(data) - s.gram + 1
        if len(data) < s.length:
            continue
        prefix = texts.prefix(data)
        grams = mix((prefix[s.gram :] - prefix[: -s.gram]) * powers(BASE_INVERSE, m))
        least, size = (grams & U64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=U64), 1  # least hash, then leftmost
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < width:
            least = np.minimum(least[: size - width], least[width - size :])
        place = (least & U64(0xFFFFFF)).astype(np.int64)
        row = row_of[a : a + len(place)]
        inside = (row == row_of[a + s.length - 1 : a + s.length - 1 + len(place)]) & ~skip[row]
        first = np.flatnonzero(inside)
        place, row = place[first], row[first]
        if not len(first):
            continue
        new = np.ones(len(first), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        begin, count = first[at], np.diff(np.append(at, len(first)))
        out.append(Runs(grams[place[at]], place[at] + a, begin + a, count, row[at].astype(np.int64), _content(prefix, begin, count, s.length)))
    if not out:
        zero = np.zeros(0, np.int64)
        return Runs(np.zeros(0, U64), zero, zero, zero, zero, np.zeros(0, U64))
    return Runs(*(np.concatenate([getattr(x, f) for x in out]) for f in Runs.__dataclass_fields__))


def by_distance(texts: Texts, runs: Runs, heavy: np.ndarray, s: SuffixSettings) -> Runs:
    """The runs, with each heavy one cut by the windows' distance to the anchor, a few distances each.

    All windows of such a part hold the bytes that are common to its distances, at
    fixed places from the anchor. The part is sorted by these bytes instead of the anchor.
    """
    if not heavy.any():
        return runs
    big, step = runs.take(heavy), s.heavy_distances
    far, near = big.place - big.first, big.place - big.first - big.count + 1  # largest and least distance
    group, times = near // step, far // step - near // step + 1
    each = np.repeat(np.arange(len(far)), times)
    group = group[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    hi, lo = np.minimum(far[each], group * step + step - 1), np.maximum(near[each], group * step)
    first, count = big.place[each] - hi, hi - lo + 1
    # What all distances of the group share: from the place less its least to the length from its largest on.
    begin, size = big.place[each] - group * step, s.length - step + 1
    sizes = count + s.length - 1

    def hashes(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = np.cumsum(length) - length
        data = texts.data[np.repeat(start - at, length) + np.arange(int(length.sum()))]
        return span_hash(texts.prefix(data), at, at + length)

    common = hashes(begin, np.full(len(begin), size))
    part = Runs(mix(common ^ mix(big.anchor[each] + group.astype(U64))), big.place[each], first, count, big.row[each], hashes(first, sizes))
    rest = runs.take(~heavy)
    return Runs(*(np.concatenate([getattr(rest, x), getattr(part, x)]) for x in Runs.__dataclass_fields__))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; buckets are ranges, so sorted hashes stay sorted by bucket."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _distinct(keys: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and with how many values of ``other`` each occurs."""
    order = np.lexsort((other, keys))
    k, o = keys[order], other[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    k = k[new]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[begin], np.diff(np.append(begin, len(k)))


# --- contexts -------------------------------------------------------------------------------


@dataclass
class Contexts:
    """The chunk's occurrences of shared anchors, and the distinct contexts that they are of."""

    key: np.ndarray  # of each distinct context: where it is sorted
    content: np.ndarray  # of each distinct context: a hash of it
    first: np.ndarray  # of each distinct context: a place of it
    windows: np.ndarray
    anchor: np.ndarray  # of each distinct context: the anchor's distance from first
    least: np.ndarray
    most: np.ndarray  # ids of the documents that hold it
    of: np.ndarray  # of each occurrence: its distinct context
    at: np.ndarray  # of each occurrence: its first window
    row: np.ndarray


def contexts(runs: Runs, ids: np.ndarray) -> Contexts:
    """The distinct contexts of the runs, and whose they are."""
    order = np.lexsort((runs.content, runs.anchor))
    k, c = runs.anchor[order], runs.content[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(new) if len(k) else np.zeros(0, np.int64)
    of = np.empty(len(k), np.int64)
    of[order] = np.cumsum(new) - 1
    owner = ids[runs.row]
    least = most = np.zeros(0, np.int64)
    if len(begin):
        least, most = np.minimum.reduceat(owner[order], begin), np.maximum.reduceat(owner[order], begin)
    pick = order[begin]
    return Contexts(runs.anchor[pick], runs.content[pick], runs.first[pick], runs.count[pick], runs.place[pick] - runs.first[pick], least, most, of, runs.first, runs.row)


# --- suffix sorting -------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts alike."""
    out = np.zeros(len(data) - 7, U64)
    for k in range(8):
        out = out << U64(8) | data[k : len(data) - 7 + k].astype(U64)
    return out


def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Dense ranks of entries, from their order and what it is by."""
    differs = np.zeros(len(order), bool)
    for k in keys:
        differs[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(differs)
    return out


def cover_ranks(words: np.ndarray, n: int, length: int) -> np.ndarray:
    """For the places below n whose residues are in the cover: ranks of the strings of ``length`` bytes or more from there on.

    Beyond n there are zeros only; these have rank 0, as the least string has.
    """
    cover = np.concatenate([np.arange(c, n, MODULUS) for c in COVER])
    rank = np.zeros(n + 2 * length + MODULUS, np.int64)
    first, other = words[cover], words[cover + MODULUS - 8]
    rank[cover] = _ranks(np.lexsort((other, first)), first, other)
    known = MODULUS
    while known < length:
        pair = rank[cover] * (len(cover) + 1) + rank[cover + known]
        rank[cover] = _ranks(np.argsort(pair), pair)
        known *= 2
    return rank


def least_ids(data: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each context: the least id of all contexts that hold it; contexts' first entries.

    The contexts are laid out so that anchors fall on multiples of the modulus.
    Equal windows have equal residues then, and one cover place serves them all.
    """
    sizes = windows + length - 1
    lead = (-anchor) % MODULUS
    room = -(-(lead + sizes) // MODULUS) * MODULUS
    begin = np.cumsum(room) - room + lead
    text = np.zeros(int(room.sum()) + 2 * length + 64, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(begin, sizes) + inside] = data[np.repeat(start, sizes) + inside]
    words = _words(text)
    reach = range(0, length + 7, 8)

    rank = cover_ranks(words, int(room.sum()) + MODULUS, length)

    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(windows)), windows)
    place = begin[owner] + np.arange(len(owner)) - first[owner]
    out = np.empty(len(owner), np.int64)
    residue = place % MODULUS
    for r in range(MODULUS):  # one bucket of suffixes at a time
        bucket = np.flatnonzero(residue == r)
        if not len(bucket):
            continue
        p, d = place[bucket], int(_TO_COVER[r])
        head = words[p] >> U64(64 - 8 * d) if d else np.zeros(len(p), U64)
        order = np.lexsort((rank[p + d], head))
        bucket, p = bucket[order], p[order]
        same = np.ones(len(p), bool)
        same[0] = False
        for k in [*range(0, length - 8, 8), length - 8]:
            same[1:] &= words[p[1:] + k] == words[p[:-1] + k]
        runs = np.flatnonzero(~same)
        ids = np.minimum.reduceat(least[owner[bucket]], runs)
        out[bucket] = np.repeat(ids, np.diff(np.append(runs, len(p))))
    return out, first


class Owners:
    """The windows of some contexts with their least ids, in runs; and what holders of the contexts owe by them."""

    def __init__(self, rows: pa.Table, s: SuffixSettings):
        rows = rows.filter(rows["context"].is_valid())
        texts = Texts(rows["context"].combine_chunks() if rows["context"].num_chunks != 1 else rows["context"].chunk(0))
        key, content, least, windows, anchor = (rows[c].to_numpy() for c in ("key", "content", "least", "windows", "anchor"))
        # Alike contexts of different chunks first become one.
        order = np.lexsort((content, key))
        k, c = key[order], content[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        begin = np.flatnonzero(new)
        pick = order[begin]
        self.key, self.content = key[pick], content[pick]
        ids, first = least_ids(texts.data, texts.start[pick], windows[pick], anchor[pick], np.minimum.reduceat(least[order], begin), s.length)
        change = np.ones(len(ids), bool)
        change[1:] = ids[1:] != ids[:-1]
        change[first] = True
        at = np.flatnonzero(change)
        self.of = np.searchsorted(first, at, side="right") - 1
        self.begin, self.size, self.least = at - first[self.of], np.diff(np.append(at, len(ids))), ids[at]

    def place(self, key: np.ndarray, content: np.ndarray) -> np.ndarray:
        """The context of each pair; all of them are here."""
        both = np.empty(len(self.key) + len(key), np.int64)
        order = np.lexsort((np.repeat([0, 1], [len(self.key), len(key)]), np.concatenate([self.content, content]), np.concatenate([self.key, key])))
        both[order] = np.cumsum(order < len(self.key)) - 1
        return both[len(self.key) :]

    def owed(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        of = self.place(rows["key"].to_numpy(), rows["content"].to_numpy())
        lo, hi = np.searchsorted(self.of, of, side="left"), np.searchsorted(self.of, of, side="right")
        row = np.repeat(np.arange(len(of)), hi - lo)
        run = np.repeat(lo, hi - lo) + np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        owes = self.least[run] < rows["most"].to_numpy()[row]
        row, run = row[owes], run[owes]
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["chunk"].to_numpy()[row]), pa.array(rows["entry"].to_numpy()[row]), pa.array(self.begin[run].astype(np.int32)), pa.array(self.size[run].astype(np.int32)), pa.array(self.least[run])], ["chunk", "entry", "from", "len", "least"]
            )


def _fewer(rows: pa.Table) -> pa.Table:
    """The rows of one key with each of its contexts on one row only, that of the least id; the others are rows of numbers."""
    content, least = rows["content"].to_numpy(), rows["least"].to_numpy()
    full = np.asarray(rows["context"].is_valid())
    order = np.lexsort((least, ~full, content))
    first = np.ones(len(order), bool)
    first[1:] = content[order[1:]] != content[order[:-1]]
    drop = np.ones(len(order), bool)
    drop[order[first]] = False
    at = rows.schema.get_field_index("context")
    kept = rows["context"].take(pa.array(np.arange(len(drop)), mask=drop))  # a null place gives a null
    return rows.set_column(at, rows.schema.field(at), kept).combine_chunks()


def resolve(batches: Iterator[pa.RecordBatch], s: SuffixSettings) -> Iterator[pa.RecordBatch]:
    """What each chunk's contexts owe to smaller ids, from rows sorted by key, those with a context first."""
    waiting: list[pa.Table] = []
    size = 0
    crowded: tuple[int, Owners] | None = None  # a key whose contexts are known, while its rows of numbers pass
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if crowded and rows.num_rows:
            upto = int(np.searchsorted(rows["key"].to_numpy(), crowded[0], side="right"))
            if upto:
                yield from crowded[1].owed(rows.slice(0, upto))
                rows = rows.slice(upto)
            if rows.num_rows:
                crowded = None
        if not rows.num_rows:
            continue
        waiting.append(rows)
        size += rows.nbytes
        if size < s.block_bytes:
            continue
        key = rows["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on in the next batch
        if cut or waiting[0]["key"][0].as_py() != key[-1]:
            done = pa.concat_tables([*waiting[:-1], rows.slice(0, cut)])
            # Without a cut in this batch, its key began in an earlier one.
            begin = int(np.searchsorted(done["key"].to_numpy(), key[-1], side="left"))
            waiting = [x for x in (done.slice(begin), rows.slice(cut)) if x.num_rows]
            done = done.slice(0, begin)
            yield from Owners(done, s).owed(done)
            size = sum(x.nbytes for x in waiting)
        if size >= s.block_bytes:  # of one key
            whole = pa.concat_tables(waiting)
            if rows["context"][-1].is_valid:
                waiting = [_fewer(whole)]
                size = waiting[0].nbytes
            else:
                crowded = (int(key[-1]), Owners(whole, s))
                yield from crowded[1].owed(whole)
                waiting, size = [], 0
    if waiting:
        rest = pa.concat_tables(waiting)
        yield from Owners(rest, s).owed(rest)


# --- the job --------------------------------------------------------------------------------


def _read_chunks(file: str, own: set[int]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """Number, ids and texts of a file's chunks, one after the other."""
    filesystem, path = pafs.FileSystem.from_uri(file)
    with filesystem.open_input_file(path) as source:
        for part in pq.ParquetFile(source, pre_buffer=False).iter_batches(1, columns=["chunk", "ids", "texts"], use_threads=False):
            chunk = column(part, "chunk")[0].as_py()
            if chunk in own:
                yield chunk, column(part, "ids").flatten(), column(part, "texts").flatten()


def _write_parts(rows: DataFrame, parts: int, path: str) -> None:
    """Rows of chunks as one folder for each part of the chunks, in order of chunk, in small row groups."""
    dealt = rows.withColumn("part", F.pmod("chunk", F.lit(parts))).repartition("part").sortWithinPartitions("part", "chunk")
    dealt.write.option("compression", "zstd").option("parquet.block.size", 1 << 20).partitionBy("part").parquet(path)


def _present(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall in, and where each begins, with the end: no work for those that are absent."""
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[begin], np.append(begin, len(bucket))


@lru_cache(maxsize=64)
def _limits(folder: str, part: int) -> tuple[tuple[str, pq.FileMetaData, tuple[tuple[int, int] | None, ...]], ...]:
    """Files of a part with their footers and the first and last chunk of each row group: read once for all chunks of the part."""
    filesystem, root = pafs.FileSystem.from_uri(folder)
    out = []
    for info in filesystem.get_file_info(pafs.FileSelector(f"{root}/part={part}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with filesystem.open_input_file(info.path) as file:
                meta = pq.ParquetFile(file).metadata
            at = meta.schema.to_arrow_schema().get_field_index("chunk")
            found = (meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups))
            out.append((info.path, meta, tuple((x.min, x.max) if x is not None and x.has_min_max else None for x in found)))
    return tuple(out)


KEPT["suffixdedup"] = _limits.cache_clear


def _of_chunk(folder: str, parts: int, chunk: int) -> pa.Table | None:
    """A chunk's rows of a table that is written in parts: only the row groups that may hold them are read."""
    filesystem, _ = pafs.FileSystem.from_uri(folder)
    tables = []
    for path, meta, limits in _limits(folder, chunk % parts):
        wanted = [k for k, x in enumerate(limits) if x is None or x[0] <= chunk <= x[1]]
        if wanted:
            with filesystem.open_input_file(path) as file:
                rows = pq.ParquetFile(file, metadata=meta).read_row_groups(wanted)
                tables.append(rows.filter(pa.compute.equal(rows["chunk"], chunk)))
    return pa.concat_tables(tables) if tables else None


def _copies(entire: DataFrame) -> DataFrame:
    """chunk, row of whole copies of a smaller id's text.

    Groups that hold a thousandth of all rows, at most a thousand groups, go to all
    tasks, so that none of them meets in one task; the others are joined by a shuffle.
    """
    groups = staged(entire.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copy-groups")
    crowded = max(2, entire.count() // 1000)
    large = groups.filter(F.col("n") >= crowded).select("hi", "lo", F.col("first").alias("known"))
    marked = entire.join(F.broadcast(large), ["hi", "lo"], "left")
    in_small = marked.filter("known is null").join(groups.filter(F.col("n") < crowded).select("hi", "lo", "first"), ["hi", "lo"]).filter("id > first")
    return marked.filter("id > known").select("chunk", "row").unionByName(in_small.select("chunk", "row"))


def remove_repeats(docs: DataFrame, settings: SuffixSettings | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Digests of every document's remaining bytes, and, ``with_text``, the bytes themselves."""
    s = settings or SuffixSettings()
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            text = pa.concat_arrays(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 24 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), pa.concat_arrays(ids)), pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text), pa.array([size], pa.int64())], ["chunk", "ids", "texts", "bytes"]
            )

        for part in slices(batches, "text", s.chunk_bytes // 4):
            ids.append(column(part, "doc_id"))
            texts.append(column(part, "text"))
            size += column(part, "text").nbytes
            if size >= s.chunk_bytes:
                yield flush()
                number, ids, texts, size = number + 1, [], [], 0
        if texts:
            yield flush()

    chunk_path = fresh_path(spark, "chunks")
    chunk_schema = "chunk long, ids array<bigint>, texts array<string>, bytes long"
    # One chunk is one row and one row group. Tasks are given files and numbers and read one chunk at a time, so no texts pass through Spark again.
    map_batches(source, chunked, chunk_schema, "suffixdedup").write.option("compression", "zstd").option("parquet.block.size", 1 << 20).option("parquet.block.size.row.check.min", 1).parquet(chunk_path)
    stored = spark.read.schema(chunk_schema).parquet(chunk_path)
    chunks = stored.select(F.col("_metadata.file_path").alias("file"), "chunk")
    total, n_chunks = stored.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, int(total * 2 / (s.length - s.gram + 2) / s.bucket_samples) + 1)
    parts = max(1, min(n_chunks, s.most_parts))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, Texts]]:
        for batch in batches:
            wanted: dict[str, set[int]] = {}
            for file, chunk in zip(column(batch, "file").to_pylist(), column(batch, "chunk").to_pylist(), strict=True):
                wanted.setdefault(file, set()).add(chunk)
            for file, own in wanted.items():
                for chunk, ids, texts in _read_chunks(file, own):
                    yield chunk, ids, ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), Texts(texts)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, numbers, texts in each(batches):
            raw = memoryview(texts.data)
            rows = np.flatnonzero(texts.end - texts.start >= s.length)
            pairs = np.array([divmod(xxhash.xxh3_128_intdigest(raw[a:b]), 1 << 64) for a, b in zip(texts.start[rows].tolist(), texts.end[rows].tolist(), strict=True)], U64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(numbers[rows]), pa.array([chunk] * len(rows), pa.int64()), pa.array(rows.astype(np.int32))], ["hi", "lo", "id", "chunk", "row"])

    # Whole copies of a smaller id's text lose all their bytes; nothing else needs them.
    copy_path = fresh_path(spark, "copies")
    _write_parts(_copies(staged(map_batches(chunks, whole, "hi long, lo long, id long, chunk long, row int", "suffixdedup"), "whole-texts")), parts, copy_path)

    def copies(chunk: int, n: int) -> np.ndarray:
        skip = np.zeros(n, bool)
        found = _of_chunk(copy_path, parts, chunk)
        if found is not None:
            skip[found["row"].to_numpy()] = True
        return skip

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, texts in each(batches):
            runs = runs_of(texts, copies(chunk, texts.n), s)
            keys, n = _distinct(runs.anchor, runs.row)
            _, kinds = _distinct(runs.anchor, runs.content)
            some, cut = _present(_bucket(keys, buckets))
            n = np.minimum(n, 15).astype(np.uint8) << 4 | np.minimum(kinds, 15).astype(np.uint8)
            spans = list(zip(cut.tolist(), cut[1:].tolist(), strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array([chunk] * len(some), pa.int64()),
                    pa.array([keys[a:e].tobytes() for a, e in spans], pa.binary()),
                    pa.array([n[a:e].tobytes() for a, e in spans], pa.binary()),
                ],
                ["bucket", "chunk", "keys", "n"],
            )

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket_states(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            keys = np.concatenate([np.frombuffer(k, U64) for _, k, _ in rows])
            n = np.concatenate([np.frombuffer(x, np.uint8) for _, _, x in rows]).astype(np.int64)
            order = np.argsort(keys)
            begin = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))

            def total(x: np.ndarray) -> np.ndarray:
                out = np.empty(len(keys), np.int64)
                out[order] = np.repeat(np.add.reduceat(x[order], begin), np.diff(np.append(begin, len(keys))))
                return out

            documents, kinds, holders = total(n >> 4), total(n & 15), total(np.ones_like(n))
            # Heavy: many chunks hold many contexts of the anchor each, so it is no run inside copies.
            heavy = (kinds >= s.heavy_from) & (kinds >= 3 * holders)
            cut = np.cumsum([0, *(len(k) // 8 for _, k, _ in rows)])
            packed = [[np.packbits(x[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)] for x in (documents >= 2, heavy)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["chunk", "bucket", "shared", "heavy"])

        bucket, waiting = None, []
        for batch in batches:
            for b, *row in zip(*(column(batch, c).to_pylist() for c in ("bucket", "chunk", "keys", "n")), strict=True):
                if waiting and b != bucket:
                    yield bucket_states(bucket, waiting)
                    waiting = []
                bucket = b
                waiting.append(row)
        if waiting:
            yield bucket_states(bucket, waiting)

    state_path = fresh_path(spark, "states")
    counted = map_batches(chunks, count, "bucket int, chunk long, keys binary, n binary", "suffixdedup").repartition(min(buckets, s.most_parts), "bucket").sortWithinPartitions("bucket")
    _write_parts(map_batches(counted, states, "chunk long, bucket int, shared binary, heavy binary", "suffixdedup"), parts, state_path)

    def with_states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, Texts, np.ndarray, Contexts]]:
        for chunk, ids, numbers, texts in each(batches):
            skip = copies(chunk, texts.n)
            runs = runs_of(texts, skip, s)
            keys, of = np.unique(runs.anchor, return_inverse=True)
            shared, heavy = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
            found = _of_chunk(state_path, parts, chunk)
            if found is not None:
                some, cut = _present(_bucket(keys, buckets))
                places = np.searchsorted(some, found["bucket"].to_numpy()).tolist()
                for b, x, y in zip(places, *(found[c].to_pylist() for c in ("shared", "heavy")), strict=True):
                    a, e = int(cut[b]), int(cut[b + 1])
                    shared[a:e] = np.unpackbits(np.frombuffer(x, np.uint8), count=e - a)
                    heavy[a:e] = np.unpackbits(np.frombuffer(y, np.uint8), count=e - a)
            runs, heavy = runs.take(shared[of]), heavy[of][shared[of]]
            yield chunk, ids, texts, skip, contexts(by_distance(texts, runs, heavy, s), numbers)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        spans: list[pa.Array] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The distinct contexts of the chunks held, the first of each with its bytes and the least id, the others as numbers."""
            key, content, chunk, entry, windows, anchor, least, most = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((content, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
            begin = np.flatnonzero(new)
            lowest, full = least.copy(), np.zeros(len(order), bool)
            full[order[begin]] = True
            lowest[order[begin]] = np.minimum.reduceat(least[order], begin)
            whole = pa.concat_arrays(spans)
            for a in range(0, len(key), 50_000):
                own = slice(a, a + 50_000)
                context = whole[own].take(pa.array(np.arange(len(full[own])), mask=~full[own]))  # a null place gives a null
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[own].view(np.int64)), pa.array(content[own].view(np.int64)), pa.array(chunk[own]), pa.array(entry[own]), context, pa.array(windows[own]), pa.array(anchor[own]), pa.array(lowest[own]), pa.array(most[own])],
                    ["key", "content", "chunk", "entry", "context", "windows", "anchor", "least", "most"],
                )

        for chunk, _, texts, _, c in with_states(batches):
            for a in range(0, len(c.key), 50_000):
                part = slice(a, a + 50_000)
                sizes = c.windows[part] + s.length - 1
                ends = np.cumsum(sizes)
                data = texts.data[np.repeat(c.first[part] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
                spans.append(pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)]))
                numbers = (np.full(len(sizes), chunk, np.int64), np.arange(a, a + len(sizes), dtype=np.int32), c.windows[part].astype(np.int32), c.anchor[part].astype(np.int32))
                held.append((c.key[part], c.content[part], *numbers, c.least[part], c.most[part]))
                size += len(data)
                if size >= s.held_bytes:
                    yield from flush()
                    held, spans, size = [], [], 0
        if held:
            yield from flush()

    sent = map_batches(chunks, send, "key long, content long, chunk long, entry int, context binary, windows int, anchor int, least long, most long", "suffixdedup")
    # Two and a half bytes go for a byte of text; reducers follow that where the session's number is too small.
    reducers = min(4 * s.most_parts, int(total * 2.5) // s.reducer_bytes)
    dealt = sent.repartition(reducers, "key") if reducers > int(spark.conf.get("spark.sql.shuffle.partitions")) else sent.repartition("key")
    by_key = dealt.sortWithinPartitions("key", F.col("context").isNull())
    owed_path = fresh_path(spark, "owed")
    _write_parts(map_batches(by_key, lambda x: resolve(x, s), "chunk long, entry int, from int, len int, least long", "suffixdedup"), parts, owed_path)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts, skip, c in with_states(batches):
            numbers = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            step = np.zeros(len(texts.data) + 1, np.int32)
            found = _of_chunk(owed_path, parts, chunk)
            if found is not None:
                entry = found["entry"].to_numpy()
                order = np.argsort(entry, kind="stable")
                entry, from_, len_, least = (found[x].to_numpy()[order].astype(np.int64) for x in ("entry", "from", "len", "least"))
                lo, hi = np.searchsorted(entry, c.of, side="left"), np.searchsorted(entry, c.of, side="right")
                occurrence = np.repeat(np.arange(len(c.of)), hi - lo)
                run = np.repeat(lo, hi - lo) + np.arange(len(occurrence)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                gone = least[run] < numbers[c.row[occurrence]]
                begin = c.at[occurrence[gone]] + from_[run[gone]]
                np.add.at(step, begin, 1)
                np.add.at(step, begin + len_[run[gone]] + s.length - 1, -1)
            removed = np.cumsum(step, dtype=np.int32)[:-1] > 0
            for row in np.flatnonzero(skip).tolist():
                removed[texts.start[row] : texts.end[row]] = True
            opens = removed.copy()
            opens[1:] &= ~removed[:-1]
            edge = texts.start[texts.start < len(removed)]
            opens[edge] = removed[edge]
            n_removed, n_spans = texts.per_row(removed), texts.per_row(opens)
            kept = [texts.data[a:b][~removed[a:b]].tobytes() for a, b in zip(texts.start.tolist(), texts.end.tolist(), strict=True)]
            arrays = [ids, pa.array(texts.end - texts.start), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(chunks, apply, SCHEMA + ", kept binary" if with_text else SCHEMA, "suffixdedup")
