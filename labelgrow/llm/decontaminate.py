"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case. Documents meet benchmark items through seeds,
shared runs of ``min_match`` tokens. An item whose seed-covered tokens could reach ``threshold`` is
tiled against the document's parts that seeds cover: running Karp-Rabin hashes tell how long the longest
match of unmarked tokens is, matches of that length are marked from the left, and so on down to
``min_match``, so that passages whose parts stand in another order are covered as well. A document is
contaminated by the items of which marked tiles cover at least ``threshold``. Memory is in proportion to
the document, however often it repeats itself.

The benchmark is a stated query set. If it has at most ``block_bytes`` of text, it is broadcast and
documents aren't shuffled at all. A longer one is taken block by block: each pass over the texts holds one
block and stores what it finds by the texts' digests, and all that was found is joined to the documents.

Defined cases: a null or empty text matches nothing; nor does an item of fewer than ``min_match`` tokens
or without an id. Repeated rows and repeated items are judged each for itself. An empty benchmark
matches nothing. Other columns ride along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, stored, text_batches
from .shingles import NOT_ALNUM, mix, parts, words

MIN_MATCH, THRESHOLD, BLOCK_BYTES = 5, 0.5, 16 << 20
_BASE = 0xD6E8FEB86659FD93
#: Tokens between runs, which no item has.
_GAP = np.uint64(0xA3B195354A39B70D)
TILE = "struct<item_at:int,doc_at:int,length:int>"
MATCH = f"struct<item_id:bigint,coverage:double,n_tokens:int,tiles:array<{TILE}>>"


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens, and where each text's begin, with the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return words(pc.utf8_lower(column.cast(pa.large_string())), NOT_ALNUM)


def _running(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and factors from which the Karp-Rabin hashes of windows of any length follow."""
    power = np.full(len(x), _BASE, np.uint64)
    power[:1] = 1
    inverse = np.full(len(x), pow(_BASE, -1, 2**64), np.uint64)
    inverse[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.multiply.accumulate(power), dtype=np.uint64)])
    return sums, np.multiply.accumulate(inverse)


def _windows(running: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    """Hashes modulo 2**64 of the windows of a length that begin at the given places."""
    sums, inverse = running
    return mix((sums[at + length] - sums[at]) * inverse[at])


def running_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all windows of a length."""
    return _windows(_running(x), np.arange(max(0, len(x) - length + 1)), length)


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Where windows without a marked token begin."""
    if len(marked) < length:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[length:] == total[:-length])


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, in the document, length), none overlapping.

    The longest match of unmarked tokens comes first; of equal ones the leftmost in the item, then in
    the document.
    """
    run_item, run_doc = _running(item), _running(doc)
    used_item, used_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = _free(used_item, length), _free(used_doc, length)
        i_hash, j_hash = _windows(run_item, i, length), _windows(run_doc, j, length)
        i_in, j_in = np.isin(i_hash, j_hash), np.isin(j_hash, i_hash)
        return i[i_in], i_hash[i_in], j[j_in], j_hash[j_in]

    tiles, most = [], min(len(item), len(doc))
    while most >= min_match:
        low, high, best = min_match, most, None
        while low <= high:  # a match of some length holds matches of all smaller ones
            length = (low + high) // 2
            found = shared(length)
            if len(found[0]):
                low, best = length + 1, (length, found)
            else:
                high = length - 1
        if best is None:
            return tiles
        most, (i_at, i_hash, j_at, j_hash) = best
        order = np.argsort(j_hash, kind="stable")
        j_at, j_hash = j_at[order], j_hash[order]
        begin, end = np.searchsorted(j_hash, i_hash), np.searchsorted(j_hash, i_hash, "right")
        passed: dict[int, int] = {}  # of the places of a hash, those before are marked
        for i, a, b in zip(i_at.tolist(), begin.tolist(), end.tolist(), strict=True):
            if used_item[i : i + most].any():
                continue
            at = passed.get(a, a)
            while at < b:
                j = int(j_at[at])
                blocked = np.flatnonzero(used_doc[j : j + most])
                if not len(blocked):
                    used_item[i : i + most] = used_doc[j : j + most] = True
                    tiles.append((i, j, most))
                    break
                at += int(np.searchsorted(j_at[at:b], j + int(blocked[-1]) + 1))
            passed[a] = at
    return tiles


def _covered(doc: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of windows at these places, runs parted by one that matches nothing, and where each stood."""
    inside = np.zeros(len(doc) + 1, np.int32)
    np.add.at(inside, places, 1)
    np.add.at(inside, places + length, -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = ~inside & np.concatenate([[False], inside[:-1]])
    at = np.flatnonzero(inside | edge)
    own = doc[at].copy()
    own[edge[at]] = np.arange(int(edge.sum()), dtype=np.uint64) * np.uint64(2) + _GAP
    return own, at


class _Items:
    """A block of benchmark items with their seeds in order."""

    def __init__(self, ids: list[int], texts: pa.Array, min_match: int) -> None:
        hashes, at = tokens(texts)
        self.ids, self.items = ids, [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        seeds = [running_hashes(x, min_match) for x in self.items]
        seed = np.concatenate([np.zeros(0, np.uint64), *seeds])
        whose = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        place = np.concatenate([np.zeros(0, int), *[np.arange(len(x)) for x in seeds]])
        order = np.argsort(seed, kind="stable")
        self.seed, self.whose, self.place = seed[order], whose[order], place[order]
        self.known = np.unique(seed)
        self.filled = np.zeros(1 << 22, bool)
        self.filled[self.known >> np.uint64(42)] = True

    def among(self, values: np.ndarray) -> np.ndarray:
        """Which values are seeds; a bitmap of 22 bits of them spares most searches."""
        out = self.filled[values >> np.uint64(42)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.known, values[some]), len(self.known) - 1)
            out[some] = self.known[at] == values[some]
        return out

    def judge(self, doc: np.ndarray, places: np.ndarray, found: np.ndarray, min_match: int, threshold: float) -> list[dict]:
        """Matches of a document that has the items' seeds ``found`` at ``places``."""
        own = where = None
        covered: dict[int, np.ndarray] = {}
        for s in np.unique(found):
            for at in range(np.searchsorted(self.seed, s), np.searchsorted(self.seed, s, "right")):
                i = int(self.whose[at])
                covered.setdefault(i, np.zeros(len(self.items[i]), bool))[self.place[at] : self.place[at] + min_match] = True
        out = []
        for i, cover in sorted(covered.items()):
            if cover.mean() >= threshold:
                if own is None:
                    own, where = _covered(doc, places, min_match)
                tiles = [(a, int(where[b]), n) for a, b, n in greedy_tiles(self.items[i], own, min_match)]
                coverage = sum(x[2] for x in tiles) / len(cover)
                if coverage >= threshold:
                    names = ("item_at", "doc_at", "length")
                    out.append({"item_id": self.ids[i], "coverage": coverage, "n_tokens": len(cover), "tiles": [dict(zip(names, x, strict=True)) for x in tiles]})
        return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out_col: str = "matches",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds the benchmark items that contaminate each row, an empty array if none does.

    If the table has a column ``out_col``, the new one gets a leading underscore.
    """
    (out_col,) = fresh(docs, out_col)
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    kind = T._parse_datatype_string(f"array<{MATCH}>")
    arrow = pa.list_(
        pa.struct(
            [
                ("item_id", pa.int64()),
                ("coverage", pa.float64()),
                ("n_tokens", pa.int32()),
                ("tiles", pa.list_(pa.struct([(x, pa.int32()) for x in ("item_at", "doc_at", "length")]))),
            ]
        )
    )
    none = text_batches(docs).withColumn(out_col, F.array().cast(kind))

    def judged(rows: DataFrame, block: int) -> DataFrame:
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((own.column("id").to_pylist(), own.column("text").to_pylist()))
        text, last = rows.columns.index(text_col), rows.columns.index(out_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            held = _Items(ids, pa.array(texts, pa.large_string()), min_match)
            for batch in chain.from_iterable(parts(b, text) for b in batches):
                hashes, at = tokens(batch.column(text))
                seeds = running_windows(hashes, min_match)
                hit = np.flatnonzero(held.among(seeds))
                hit = hit[at[np.searchsorted(at, hit, "right")] >= hit + min_match]
                of = np.searchsorted(at, hit, "right") - 1
                found: list[list[dict]] = [[]] * batch.num_rows
                for i in np.unique(of):
                    here = hit[of == i]
                    found[i] = held.judge(hashes[at[i] : at[i + 1]], here - at[i], seeds[here], min_match, threshold)
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(found, arrow)], names=batch.schema.names)

        return rows.mapInArrow(run, rows.schema)

    if blocks <= 1:
        return judged(none, 0) if blocks else none
    (digest,) = fresh(none, "digest")
    texts = none.select(text_col, out_col)
    each = [stored(judged(texts, b).filter(F.size(out_col) > 0).select(F.unhex(F.md5(text_col)).alias(digest), out_col).distinct(), "leaks") for b in range(blocks)]
    leaks = reduce(DataFrame.union, each).groupBy(digest).agg(F.array_sort(F.flatten(F.collect_list(out_col))).alias("_all_leaks"))
    joined = none.withColumn(digest, F.unhex(F.md5(text_col))).join(leaks, digest, "left")
    return joined.withColumn(out_col, F.coalesce("_all_leaks", out_col)).select(*none.columns)


def running_windows(hashes: np.ndarray, length: int, step: int = 1 << 18) -> np.ndarray:
    """``running_hashes`` of a long array, made in parts so that they stay in cache."""
    parts = [running_hashes(hashes[i : i + step + length - 1], length) for i in range(0, max(0, len(hashes) - length + 1), step)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])

