"""Encoding with a public byte-level BPE: whole pre-tokens by minimal perfect hash, misses by a heap over linked bytes.

Tier 1: the vocabulary's byte strings are laid out by a minimal perfect hash (hash and displace): one array of displacements and
one of entries, no empty slots; a batch's distinct pre-tokens are hashed and looked up as numpy arrays and verified against the
stored bytes. Tier 2: a pre-token that is no entry is merged from its bytes: a heap holds the ranks of neighbouring pairs over a
doubly linked list, O(n log n) however long the pre-token.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Misses remembered per worker, and characters of text worked on at a time.
REMEMBERED, AT_ONCE = 50_000, 4_000_000


def _mix(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    x = hashes ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: place(key) is a bijection from the keys to 0 .. n - 1."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        self.n, self.buckets = n, max(1, n // 3)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.seeds = np.zeros(self.buckets, np.uint32)
        taken = np.zeros(n, bool)
        self.slots = np.zeros(n, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: starts[b] - starts[b + 1]):
            members = order[starts[b] : starts[b + 1]]
            if not len(members):
                break
            # Seeds are tried in growing lots; the first that sends the bucket to free places of their own is kept.
            low, lot = 0, 64
            while True:
                seeds = np.arange(low, low + lot, dtype=np.uint64)
                places = (_mix(hashes[members][None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~taken[places].any(1)
                if len(members) > 1:
                    spread = np.sort(places, 1)
                    good &= (spread[:, 1:] != spread[:, :-1]).all(1)
                if good.any():
                    first = int(np.argmax(good))
                    self.seeds[b], self.slots[members] = low + first, places[first]
                    taken[places[first]] = True
                    break
                low, lot = low + lot, min(lot * 4, 65536)

    def places(self, keys: list[bytes]) -> np.ndarray:
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        seeds = self.seeds[(hashes % np.uint64(self.buckets)).astype(np.int64)].astype(np.uint64)
        return (_mix(hashes, seeds) % np.uint64(self.n)).astype(np.int64)


class ByteBpe:
    """The tokenizer of a .tiktoken file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
        tokens = [base64.b64decode(token) for token, _ in pairs]
        self.hash = PerfectHash(tokens)
        self.entries: list[bytes] = [b""] * len(tokens)
        self.ids = np.zeros(len(tokens), np.int32)
        for slot, token, (_, rank) in zip(self.hash.slots.tolist(), tokens, pairs):
            self.entries[slot], self.ids[slot] = token, int(rank)
        self.pattern = regex.compile(pattern)
        self.ranks = dict(zip(self.entries, self.ids.tolist()))
        self.known: dict[str, list[int]] = {}

    def lookup(self, tokens: list[bytes]) -> list[int]:
        """The id of each token that is an entry, else -1."""
        if not tokens:
            return []
        places = self.hash.places(tokens)
        ids = self.ids[places].tolist()
        return [i if self.entries[p] == t else -1 for i, p, t in zip(ids, places.tolist(), tokens)]

    def merge(self, token: bytes) -> list[int]:
        """Ids of a byte string by merging the pair of least rank, leftmost first, until none is an entry."""
        n, ranks = len(token), self.ranks
        part: list[bytes | None] = [token[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) != left or len(part[j]) != right:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]), len(part[k])))
            h = before[i]
            if h >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]), len(part[i])))
        return [ranks[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; texts are worked on together so that each distinct pre-token is looked up once."""
        split = [self.pattern.findall(t) for t in texts]
        fresh = list({p for ps in split for p in ps if p not in self.known})
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        found = {p: [i] if i >= 0 else self.merge(b) for p, b, i in zip(fresh, raw, self.lookup(raw))}
        if len(self.known) + len(found) > REMEMBERED:
            found |= {p: self.known[p] for ps in split for p in ps if p in self.known}
            self.known = {}
        else:
            self.known |= found
            found = self.known
        out = [[i for p in ps for i in found[p]] for ps in split]
        if found is not self.known and len(found) <= REMEMBERED:
            self.known = found
        return out


@cache
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer per worker process and file."""
    return ByteBpe(path)


def _encoder(path: str, count: bool):
    kind = pa.int64() if count else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                lot, held, first = [], 0, at
                while at < len(texts) and (not lot or held < AT_ONCE):
                    lot.append(texts[at].as_py() or "")
                    held += len(lot[-1])
                    at += 1
                ids = bpe.encode(lot)
                values = pa.array([len(i) for i in ids], kind) if count else pa.array(ids, kind)
                yield pa.RecordBatch.from_arrays([keys.slice(first, at - first), values], names=["key", "value"])

    return run


def encode_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): token ids of every row, in one narrow pass. Null and empty texts have an empty list; the strings of special
    tokens are ordinary text; texts of any length are encoded whole; other columns are not read."""
    rows = texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoder(f"{folder}/{name}.tiktoken", False), "key bigint, value array<int>").toDF(key, "ids")


def count_tokens(texts: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens): like `encode_texts`, only the number of ids."""
    rows = texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoder(f"{folder}/{name}.tiktoken", True), "key bigint, value bigint").toDF(key, "tokens")
