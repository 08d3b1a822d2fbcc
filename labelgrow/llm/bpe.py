"""Byte-level BPE encoding and decoding by merge ranks.

Every match of the split pattern is a pre-token; its bytes form a linked list. Pairs wait in buckets by
the rank of what they would merge to. A three-level bitmap of 64-bit words says which buckets are
filled: find-first-set gives the lowest rank without a search, so that a pre-token of any length takes
time in proportion to its length. Within a bucket the leftmost position comes first; entries whose pair
has changed meanwhile are stale and skipped. Pre-tokens don't touch each other, so those that a batch
needs lie behind one another in one list and share one queue.

Ids of pre-tokens met before are kept in two generations, each bounded in bytes, and go with the task.

Defined cases: a null text is empty and has no ids. Special tokens are never made: their strings are
plain text. Ids that the ranks don't hold raise on decoding. Other columns ride along.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, text_batches
from .shingles import parts

#: Bytes of pre-tokens and ids that a task keeps in each of two generations, each entry counted with ``ENTRY`` more.
CACHE_BYTES, ENTRY = 48 << 20, 200
#: New pre-tokens that are encoded at once, and their bytes: above either, what is there is encoded.
AT_ONCE, BYTES_AT_ONCE = 20_000, 1 << 18


class RankQueue:
    """Positions by rank; the lowest rank is found through bitmaps of 64 bits on each level."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def fill(self, rank: int, positions: list[int]) -> None:
        """A new bucket; one that exists is appended to by whoever holds it."""
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def take(self) -> tuple[int, list[int]]:
        """Takes the bucket of the lowest rank, leftmost position first; rank -1 if none is filled."""
        if not self.top:
            return -1, []
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        self.low[a] = word & (word - 1)
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class BytePairs:
    """A vocabulary of ranks with the ids of pairs and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.top = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = {i: x for x, i in ranks.items()}
        #: left id << 32 | right id -> id of both, for all ways to cut a token in two
        self.pairs = {ranks[x[:i]] << 32 | ranks[x[i:]]: r for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks}
        #: the same of single bytes, -1 where they don't merge
        self.first = np.full(65536, -1, np.int32)
        for x, r in ranks.items():
            if len(x) == 2:
                self.first[x[0] << 8 | x[1]] = r

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as if it were alone, packed as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)  # a position after each piece that nothing merges across
        n = int(ends[-1]) + 1 if len(pieces) else 1
        inside = np.ones(n, bool)
        inside[ends - 1] = inside[n - 1] = False
        data = np.zeros(n, np.int32)
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.where(inside, self.single[data], np.int32(-1))
        merge = np.full(n, -1, np.int32)  # the rank that the pair beginning here would merge to
        both = np.flatnonzero(inside[:-1] & inside[1:])
        merge[both] = self.first[data[both] << 8 | data[both + 1]]
        queue = RankQueue(self.top)
        open_at = np.flatnonzero(merge >= 0)
        open_at = open_at[np.argsort(merge[open_at], kind="stable")]
        cuts = np.flatnonzero(np.diff(merge[open_at], prepend=-2))
        for a, b in zip(cuts.tolist(), np.append(cuts, len(open_at))[1:].tolist(), strict=True):
            queue.fill(int(merge[open_at[a]]), open_at[a:b].tolist())
        hold = np.ndarray.tolist if n < 1 << 20 else lambda x: array("i", x.tobytes())  # arrays take less room than lists
        ids, waiting = hold(start), hold(merge)
        following, before = hold(np.arange(1, n + 1, dtype=np.int32)), hold(np.arange(-1, n - 1, dtype=np.int32))
        get, bucket_of, fill = self.pairs.get, queue.buckets.get, queue.fill
        while True:
            rank, bucket = queue.take()
            if rank < 0:
                break
            lower = False
            for i in bucket:
                if waiting[i] != rank:
                    continue  # stale
                j = following[i]
                after = following[i] = following[j]
                h = before[i]  # -1, the last position, before the first
                before[after] = i
                ids[i], ids[j], waiting[j] = rank, -2, -1
                new = waiting[i] = get(rank << 32 | ids[after], -1)  # an id of -1 makes a key that no pair has
                if new >= 0:
                    filled = bucket_of(new)
                    if filled:
                        filled.append(i)
                    else:
                        fill(new, [i])
                        lower = new < rank
                new = waiting[h] = get(ids[h] << 32 | rank, -1)
                if new >= 0:
                    filled = bucket_of(new)
                    if filled:
                        filled.append(h)
                    else:
                        fill(new, [h])
                        lower = lower or new < rank
                if lower:  # what merges first comes first; the rest waits, entries that are done are stale
                    fill(rank, bucket)
                    break
        made = np.array(ids, np.int32)
        kept = made >= 0
        packed = made[kept].astype("<u4").tobytes()
        at = (np.concatenate([[0], np.cumsum(kept)[ends - 1]]) * 4).tolist()
        return [packed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def vocabulary(path: str) -> BytePairs:
    """Reads a rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


class Encoder:
    """Encodes whole texts; pre-tokens met before come from a bounded memory."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pairs, self.cut = vocabulary(path), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        begin = 0
        while begin < len(texts):
            if self.size > CACHE_BYTES:
                self.known, self.older, self.size = {}, self.known, 0
            known, older, ranks = self.known, self.older, self.pairs.ranks
            missing: dict[str, None] = {}
            cuts, size = [], 0
            while begin < len(texts) and len(missing) < AT_ONCE and size < BYTES_AT_ONCE:
                pieces = self.cut(texts[begin])
                cuts.append(pieces)
                for piece in set(pieces).difference(known):
                    if piece in older:
                        ids = known[piece] = older[piece]
                        self.size += ENTRY + len(piece) + len(ids)
                    elif piece not in missing:
                        missing[piece] = None
                        size += len(piece)
                begin += 1
            new = list(missing)
            coded = [x.encode() for x in new]
            whole = [ranks.get(x) for x in coded]  # a pre-token that is a token needs no merges
            made = iter(self.pairs.encode_all([x for x, r in zip(coded, whole, strict=True) if r is None]))
            for piece, rank in zip(new, whole, strict=True):
                ids = known[piece] = next(made) if rank is None else rank.to_bytes(4, "little")
                self.size += ENTRY + len(piece) + len(ids)
            del coded, made
            for pieces in cuts:
                yield b"".join(map(known.__getitem__, pieces))


def _whole_matches(pattern: str) -> str:
    """The pattern with its groups not captured, so that findall gives the matches."""
    return regex.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def _added(docs: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([*docs.schema.fields, *[T.StructField(x, T.BinaryType()) for x in names]])


def _decoded(pairs: BytePairs, packed: list[bytes | None]) -> pa.Array:
    return pa.array([pairs.decode(memoryview(x or b"").cast("I")) for x in packed], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """Adds the ids of each whole text, packed as little-endian unsigned 32-bit integers (see ``unpacked``).

    With ``bytes_col``, the ids are decoded again in the same pass and a column of their bytes is added.
    ``path`` is a rank file that every executor can open. If the table has columns of these names, the
    new ones get a leading underscore.
    """
    names = fresh(docs, ids_col, *([bytes_col] if bytes_col else []))
    pattern = _whole_matches(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in chain.from_iterable(parts(b, b.schema.get_field_index(text_col)) for b in batches):
            packed = list(encoder.packed([x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]))
            new = [pa.array(packed, pa.binary())] + ([_decoded(encoder.pairs, packed)] if bytes_col else [])
            del packed
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])
        del encoder
        pa.default_memory_pool().release_unused()

    return text_batches(docs).mapInArrow(run, _added(docs, names))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the bytes that each row's packed ids stand for; null ids are none."""
    (bytes_col,) = fresh(docs, bytes_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary(path)
        for batch in chain.from_iterable(parts(b, b.schema.get_field_index(ids_col)) for b in batches):
            out = _decoded(pairs, batch.column(batch.schema.get_field_index(ids_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, bytes_col])

    return text_batches(docs).mapInArrow(run, _added(docs, [bytes_col]))


def n_ids(packed: Column) -> Column:
    return F.call_function("div", F.octet_length(packed).cast("long"), F.lit(4))


def unpacked(packed: Column) -> Column:
    """Packed ids as an array of long."""

    def word(i: Column) -> Column:
        digits = F.hex(F.substring(packed, i * 4 + 1, F.lit(4)))
        return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")

    return F.when(n_ids(packed) > 0, F.transform(F.sequence(F.lit(0), (n_ids(packed) - 1).cast("int")), word)).otherwise(F.array().cast("array<bigint>"))


__all__ = ["BytePairs", "RankQueue", "decode", "encode", "n_ids", "unpacked", "vocabulary"]
