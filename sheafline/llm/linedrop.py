"""Line dedup by a sharded minimal perfect hash.

1. Every document's distinct line keys become 128-bit hashes; a partition
   pre-aggregates them to (hash, number of documents, largest document id), and
   one narrow shuffle adds these up. Line texts are never shuffled, and a line
   that every document holds costs one row per partition.
2. The hashes that enough documents hold are dealt into shards. A shard's
   minimal perfect hash (levels of bit arrays with ranks) numbers its hashes
   0..n-1 and indexes three compact arrays: fingerprint, count, last document.
   Shards are files of a table in the shared folder.
3. Documents probe the arrays map-side. A task first hashes the lines of a window
   of ``window_bytes`` of text (as a rule its whole partition), then reads each
   shard that they fall in once. One shard is in memory at a time, beside a
   bounded cache; reads grow with windows times shards.

Defined cases: a null or empty text is one empty line; a line's key is stripped
of the six spaces and has A-Z lower-cased; keys under ``min_chars`` code points
are never dropped; rows with the same doc_id count as one document, and each is
judged by that id; a row with a null doc_id counts as a document but never holds
the last copy; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import KEPT, column, map_batches, mix, slices
from sheafline.session import fresh_path, remove_path, ship

U64 = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
_NO_DOC = -(1 << 63)


# --- minimal perfect hash -------------------------------------------------------------------


def build_mphf(hi: np.ndarray, lo: np.ndarray, factor: float = 1.5) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of packed bit arrays for distinct 128-bit keys, and each key's slot.

    On each level a key sets the bit that it hashes to; keys alone on their bit
    stay, the others go to the next level. A key's slot is the rank of its bit.
    Every level hashes both halves, so keys that share one half still part.
    """
    levels: list[np.ndarray] = []
    slot = np.full(len(hi), -1, np.int64)
    left, used = np.arange(len(hi)), 0
    while len(left):
        size = (int(len(left) * factor) // 64 + 1) * 64  # whole words, so that the reader knows it
        place = (level_hash(hi[left], lo[left], len(levels)) % U64(size)).astype(np.int64)
        hits = np.bincount(place, minlength=size)
        alone = hits == 1
        rank = np.cumsum(alone) - 1 + used
        ok = alone[place]
        slot[left[ok]] = rank[place[ok]]
        used += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~ok]
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    return levels, slot


def level_hash(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    turn = (0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)
    return mix(hi + U64(turn) ^ mix(lo + U64(turn ^ 0xD1B54A32D192ED03)))


class Shard:
    """One shard's hash function and its arrays: a bit per place, a rank per 64 places, three values per key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.fingerprint, self.count, self.last = fingerprint, count, last
        self.levels, at, used = [], 0, 0
        for size in sizes:
            words = bits[at : at + size].copy().view("<u8")
            at += size
            ones = np.bitwise_count(words).astype(np.int32)
            self.levels.append((words, np.cumsum(ones, dtype=np.int32) - ones + np.int32(used)))
            used += int(ones.sum())
        self.nbytes = sum(b.nbytes + r.nbytes for b, r in self.levels) + fingerprint.nbytes + count.nbytes + last.nbytes

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the fingerprint (the key's lower half) differs or no level has it."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for k, (words, rank) in enumerate(self.levels):
            if not len(left):
                break
            place = level_hash(hi[left], lo[left], k) % U64(len(words) * 64)
            word, bit = words[place >> U64(6)], place & U64(63)
            hit = (word >> bit & U64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            out[left[hit]] = rank[place[hit] >> U64(6)] + below
            left = left[~hit]
        found = out >= 0
        out[found] = np.where(self.fingerprint[out[found]] == lo[found].view(np.int64), out[found], -1)
        return out


# --- lines ----------------------------------------------------------------------------------


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines, and their hashes (None where a line is too short to be dropped)."""
    lines = (text or "").encode().split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACES)
        if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
            keys.append(None)
        else:
            keys.append(xxhash.xxh3_128_digest(key.lower()))  # lower() of bytes changes A-Z only
    return lines, keys


def _as_pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").astype(U64).reshape(-1, 2)


def repeats_ids(docs: DataFrame) -> bool:
    """Does any doc_id occur on two rows. Reads the id column only."""
    return bool(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").take(1))


def count_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """hi, lo, n, last: number of documents and largest id of each line key."""
    apart = repeats_ids(docs)  # then documents are told apart by id before they are counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 24):
            total: dict[bytes | tuple[bytes, int], list[int]] = {}
            for doc_id, text in zip(column(part, "doc_id").to_pylist(), column(part, "text"), strict=True):
                keys = set(line_keys(text.as_py(), min_chars)[1])
                keys.discard(None)
                number = _NO_DOC if doc_id is None else doc_id
                for key in keys:
                    entry = (key, number) if apart and doc_id is not None else key
                    have = total.get(entry)
                    if have is None:
                        total[entry] = [1, number]
                    elif entry is key:
                        have[0] += 1
                        have[1] = max(have[1], number)
            if total:
                pairs = _as_pairs([k if type(k) is bytes else k[0] for k in total]).view(np.int64)
                values = np.array(list(total.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pairs[:, 0], pairs[:, 1], values[:, 0], values[:, 1])], ["hi", "lo", "n", "last"])

    rows = map_batches(docs, run, "hi long, lo long, n long, last long", "linedrop")
    if apart:
        rows = rows.groupBy("hi", "lo", "last").agg(F.when(F.col("last") == _NO_DOC, F.sum("n")).otherwise(F.lit(1)).alias("n"))
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def build_index(counts: DataFrame, shard_keys: int = 1 << 20) -> tuple[str, int]:
    """Write one file of arrays per shard; the folder and the number of shards.

    ``counts`` is aggregated once: the rows that pass are written, counted, then dealt.
    """
    spark = counts.sparkSession
    kept_path = fresh_path(spark, "line-hashes")
    counts.write.option("compression", "zstd").parquet(kept_path)
    kept = spark.read.schema(counts.schema).parquet(kept_path)
    shards = max(1, -(-kept.count() // shard_keys))
    folder = fresh_path(spark, "line-index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_shard(batches):
            hi, lo, n, last = (np.asarray(table[c]) for c in ("hi", "lo", "n", "last"))
            levels, slot = build_mphf(hi.view(U64), lo.view(U64))
            order = np.argsort(slot)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(table["shard"][0])], pa.int32()),
                    pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(levels) if levels else np.zeros(0, np.uint8), lo[order], np.minimum(n[order], 2**31 - 1).astype(np.int32), last[order])),
                ],
                ["shard", "sizes", "bits", "fingerprint", "count", "last"],
            )

    # The 128-bit hashes of one shard are distinct and about shard_keys: the group is bounded.
    dealt = kept.withColumn("shard", F.pmod(F.shiftrightunsigned("hi", 40), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard")
    built = map_batches(dealt, build, "shard int, sizes array<bigint>, bits binary, fingerprint binary, count binary, last binary", "linedrop")
    built.withColumn("part", F.col("shard")).write.partitionBy("part").parquet(folder)
    remove_path(spark, kept_path)
    return folder, shards


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole shards of a partition that is sorted by shard."""
    names = ("shard", "hi", "lo", "n", "last")
    waiting: list[dict[str, np.ndarray]] = []
    for batch in batches:
        cols = {c: column(batch, c).to_numpy(zero_copy_only=False) for c in names}
        cuts = [0, *(np.flatnonzero(np.diff(cols["shard"])) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = {c: v[a:b] for c, v in cols.items()}
            if b > a:
                if waiting and waiting[-1]["shard"][0] != piece["shard"][0]:
                    yield {c: np.concatenate([w[c] for w in waiting]) for c in names}
                    waiting = []
                waiting.append(piece)
    if waiting:
        yield {c: np.concatenate([w[c] for w in waiting]) for c in names}


class Index:
    """The shards of a folder, loaded when needed; at most ``keep_bytes`` of them stay."""

    def __init__(self, folder: str, shards: int, keep_bytes: int = 1 << 27):
        self.filesystem, self.root = pafs.FileSystem.from_uri(folder)
        self.shards, self.keep_bytes = shards, keep_bytes
        self.loaded: OrderedDict[int, Shard | None] = OrderedDict()

    def shard(self, k: int) -> Shard | None:
        if k in self.loaded:
            self.loaded.move_to_end(k)
            return self.loaded[k]
        found = [x.path for x in self.filesystem.get_file_info(pafs.FileSelector(f"{self.root}/part={k}", allow_not_found=True)) if x.path.endswith(".parquet")]
        shard = None
        if found:
            with self.filesystem.open_input_file(found[0]) as file:
                row = pq.ParquetFile(file).read(columns=["sizes", "bits", "fingerprint", "count", "last"]).to_pylist()[0]
            shard = Shard(np.array(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["fingerprint"], np.int64), np.frombuffer(row["count"], np.int32), np.frombuffer(row["last"], np.int64))
        self.loaded[k] = shard
        while sum(s.nbytes for s in self.loaded.values() if s) > self.keep_bytes and len(self.loaded) > 1:
            self.loaded.popitem(last=False)
        return shard

    def last_document(self, pairs: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """For each hash: do min_docs documents hold it; the last of these."""
        many, last = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        of = ((pairs[:, 0] >> U64(40)) % U64(self.shards)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.shards + 1))
        for k in range(self.shards):
            own = order[cuts[k] : cuts[k + 1]]
            shard = self.shard(k) if len(own) else None
            if shard is None:
                continue
            slot = shard.probe(pairs[own, 0], pairs[own, 1])
            hit = slot >= 0
            many[own[hit]] = shard.count[slot[hit]] >= min_docs
            last[own[hit]] = shard.last[slot[hit]]
        return many, last


_open: dict[str, Index] = {}


KEPT["linedrop"] = _open.clear


def index_of(folder: str, shards: int) -> Index:
    """The worker's view of an index; one at a time."""
    if folder not in _open:
        _open.clear()
        _open[folder] = Index(folder, shards)
    return _open[folder]


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False, window_bytes: int = 1 << 26) -> DataFrame:
    """Drop lines that ``min_docs`` documents hold, except in the last of these documents.

    Gives digests by document, or, to ``rewrite``, the input with its text column
    rewritten (a null text stays null) and all its other columns as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = count_lines(source, min_chars).filter(F.col("n") >= min_docs)
    folder, shards = build_index(counts)

    def judged(index: Index, batches: Iterator[pa.RecordBatch], id_name: str, text_name: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
        """Each slice of the batches with its rows' numbers of lines, dropped lines, and remaining bytes."""
        for window in _windows_of(batches, text_name, window_bytes):
            keyed, found = [], []
            for part in window:
                keys = [line_keys(t.as_py(), min_chars)[1] for t in column(part, text_name)]
                keyed.append([np.array([k is not None for k in own], bool) for own in keys])
                found.append(_as_pairs([k for own in keys for k in own if k is not None]))
            many, last = index.last_document(np.concatenate(found), min_docs)
            at = 0
            for part, masks in zip(window, keyed, strict=True):
                rows = []
                for doc_id, text, mask in zip(column(part, id_name).to_pylist(), column(part, text_name), masks, strict=True):
                    n = int(mask.sum())
                    gone = np.zeros(len(mask), bool)
                    gone[mask] = many[at : at + n] & (last[at : at + n] != doc_id if doc_id is not None else True)
                    at += n
                    data = (text.as_py() or "").encode()
                    if gone.any():
                        data = b"\n".join(line for line, out in zip(data.split(b"\n"), gone.tolist(), strict=True) if not out)
                    rows.append((len(mask), int(gone.sum()), data))
                yield part, rows

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in judged(index_of(folder, shards), batches, "doc_id", "text"):
            n, dropped, data = zip(*rows, strict=True)
            sha = [hashlib.sha256(x).hexdigest() for x in data]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in judged(index_of(folder, shards), batches, id_col, text_col):
            texts = column(part, text_col)
            new = [data.decode() if text.is_valid else None for text, (_, _, data) in zip(texts, rows, strict=True)]
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(new, texts.type))

    return map_batches(docs, rewritten, docs.schema, "linedrop") if rewrite else map_batches(source, digest, SCHEMA, "linedrop")


def _windows_of(batches: Iterator[pa.RecordBatch], text_name: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of slices with about ``most`` bytes of text."""
    waiting, size = [], 0
    for part in slices(batches, text_name, 1 << 21):
        waiting.append(part)
        size += column(part, text_name).nbytes
        if size >= most:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting
