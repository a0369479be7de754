"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a slice form a trie: kept as the sorted list of words,
where the common prefix of neighbours is the path they share. A depth-first walk
keeps, for every symbol of the current path, the last token of that prefix's
encoding. A prefix's last token is the one token that ends it and forms a valid
pair with the last token of what stands before (a pair is valid if the merges
leave it apart), so each trie node is worked out once, whatever the number of
words below it. A word's end is a node of its own, because its last symbol
carries the end-of-word suffix.

Map-only. Encodings of words are kept per worker in a table of bounded size;
when it is full it starts anew, which changes nothing but time.

Defined cases: a null text counts as empty and has no tokens; special tokens
written in a text get their own ids, as the file's added tokens say; repeated
rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import KEPT, column, map_batches, slices
from sheafline.session import ship

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SCHEMA_FULL = SCHEMA + ", token_ids array<int>, decoded string"

# Letters and number signs up to U+024F, for texts without other letters.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_NEAR = re.compile(rf"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_L}{_N}]+")
_FAR = regex.compile(r"\p{L}+|\p{N}|'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+")
_BEYOND = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u203a\\u20ac]|\\u0085|\\u00a0|[\\x1c-\\x1f]|\\u0130")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes words of one vocabulary file by walks over a trie of them."""

    def __init__(self, path: str, keep_words: int = 300_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        #: What every added token begins with: a text without it has none of them.
        self.added_sign = os.path.commonprefix(list(self.added))
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.symbols = byte_symbols()
        # Tokens as tuples would be slow keys; inside, an end-of-word token is its text and one mark.
        self.inner: dict[str, int] = {}
        for token, i in self.vocab.items():
            if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
                self.inner[token[: -len(self.suffix)] + "\n"] = i
            else:
                self.inner[token] = i
        self.size = {i: len(t.removesuffix("\n")) for t, i in self.inner.items()}
        self.tails = {t[k:] for t in self.inner for k in range(len(t)) if t[k:] != "\n"}
        self.whole = {i: self._merge(self._split(t)) == [i] for t, i in self.inner.items()}
        self.pair: dict[int, bool] = {}
        self.keep_words = keep_words
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.nodes = 0

    @staticmethod
    def _split(token: str) -> list[str]:
        marked = token.endswith("\n")
        parts = list(token[:-1] if marked else token)
        if marked:
            parts[-1] += "\n"
        return parts

    def _merge(self, parts: list[str]) -> list[int]:
        """The merges one by one, lowest rank first, leftmost first: what defines an encoding."""
        outer = [p[:-1] + self.suffix if p.endswith("\n") else p for p in parts]
        while len(outer) > 1:
            ranked = [(self.rank.get(pair, 1 << 60), k) for k, pair in enumerate(zip(outer, outer[1:], strict=False))]
            rank, _ = min(ranked)
            if rank == 1 << 60:
                break
            out, k = [], 0
            while k < len(outer):
                if k + 1 < len(outer) and ranked[k][0] == rank:
                    out.append(outer[k] + outer[k + 1])
                    k += 2
                else:
                    out.append(outer[k])
                    k += 1
            outer = out
        return [self.vocab[t] for t in outer]

    def _valid(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) > 300_000:
                self.pair.clear()
            known = self._merge(self._split(self._inner_text(left)) + self._split(self._inner_text(right))) == [left, right]
            self.pair[key] = known
        return known

    def _inner_text(self, token: int) -> str:
        text = self.text_of[token]
        if self.suffix and text.endswith(self.suffix) and len(text) > len(self.suffix):
            return text[: -len(self.suffix)] + "\n"
        return text

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each of the distinct words, by one depth-first walk over their trie."""
        symbols, inner, tails, pair, size = self.symbols, self.inner, self.tails, self.pair, self.size
        end_mark = "\n" if self.suffix else ""
        paths = sorted([("".join([symbols[b] for b in w.encode()]), w) for w in words])
        last: list[int] = [0]  # last[k]: the last token of the path's first k symbols
        before, out = "", {}
        for path, word in paths:
            n = len(path)
            shared, most = 0, min(len(last) - 1, n - 1)
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            self.nodes += n - shared
            for k in range(shared + 1, n + 1):
                mark = end_mark if k == n else ""
                begin, found = k - 1, -1
                while begin >= 0:
                    tail = path[begin:k] + mark
                    if tail not in tails:
                        break
                    token = inner.get(tail)
                    if token is not None:
                        if begin:
                            valid = pair.get(last[begin] << 32 | token)
                            if valid is None:
                                valid = self._valid(last[begin], token)
                        else:
                            valid = self.whole[token]
                        if valid:
                            found = token
                            break
                    begin -= 1
                if found < 0:
                    raise AssertionError(f"no token ends {path[:k]!r}")
                if k < n:
                    last.append(found)
            ids, at = [found], n - size[found]
            while at > 0:
                token = last[at]
                ids.append(token)
                at -= size[token]
            ids.reverse()
            out[word] = ids
            before = path
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if _BEYOND.search(text) is None:
            return _NEAR.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        lowered = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return _FAR.findall(lowered)

    def split(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens, in their order."""
        if self.added_pattern is None or self.added_sign not in text:
            return self.pieces(text)
        out: list[str | int] = []
        at = 0
        for m in self.added_pattern.finditer(text):
            out += self.pieces(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.pieces(text[at:])

    def learn(self, words: set[str]) -> None:
        """Have the encodings of these words at hand."""
        new = words - self.ids.keys()
        if len(self.ids) + len(new) > self.keep_words:
            self.ids.clear()
            self.texts.clear()
            new = words
        for word, ids in self.encode_words(new).items():
            self.ids[word] = np.array(ids, "<u4").tobytes()
            self.texts[word] = " ".join([self.text_of[i] for i in ids])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each text."""
        split = [self.split(t) for t in texts]
        distinct: set[str | int] = set()
        for words in split:
            distinct.update(words)
        self.learn({w for w in distinct if type(w) is str})
        for text, words in zip(texts, split, strict=True):
            if self.added and self.added_sign in text:
                yield (
                    b"".join([np.array([w], "<u4").tobytes() if type(w) is int else self.ids[w] for w in words]),
                    " ".join([self.text_of[w] if type(w) is int else self.texts[w] for w in words]),
                )
            else:
                yield b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.texts.__getitem__, words))

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join([self.text_of[i] for i in ids if i in self.text_of])


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


KEPT["bpe"] = encoder.cache_clear


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False) -> DataFrame:
    """Token ids and decoded text of every document, as digests or, ``with_tokens``, themselves.

    ``vocabulary`` is the path of a tokenizer file on every executor.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = encoder(vocabulary)
        for part in slices(batches, "text"):
            texts = [t or "" for t in column(part, "text").to_pylist()]
            n, ids_sha, text_sha, ids_all, text_all = [], [], [], [], []
            for ids, decoded in trie.encode_batch(texts):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_tokens:
                    ids_all.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    text_all.append(decoded)
            arrays = [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_tokens:
                arrays += [pa.array(ids_all, pa.list_(pa.int32())), pa.array(text_all, pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, run, SCHEMA_FULL if with_tokens else SCHEMA, "bpe")
