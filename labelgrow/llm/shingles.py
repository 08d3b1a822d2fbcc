r"""Words and word shingles of Arrow text columns as numpy arrays.

A word is a run of characters outside ``[\x20\x09-\x0D]`` with A-Z in lower case. All these characters
are single bytes in UTF-8, so words are cut and hashed on the column's bytes without a Python object
per word. A word's hash is a polynomial of random values of its bytes modulo 2**64, mixed; a shingle's
hash is a mixed combination of its words' hashes. Windows bound the memory beside the column itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WINDOW = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20))
_VALUE = _rng.integers(1, 2**64 - 1, 256, dtype=U) | U(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE[65:91] = _VALUE[97:123]
_P = 0x9E3779B97F4A7C15
_MIX = _rng.integers(1, 2**64 - 1, 64, dtype=U) | U(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_P, pow(_P, -1, 2**64)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the place where each text begins, with the end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def words(column: pa.Array | pa.ChunkedArray, blanks: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each text the number of the first of its words, with the end.

    ``blanks`` says of each of the 256 bytes whether it parts words.
    """
    data, at = text_bytes(column)
    lo, end = int(at[0]), int(at[-1])
    first: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    while lo < end:
        hi = min(lo + WINDOW, end)
        while hi < end:  # cut where a text begins or after a blank
            start = int(at[np.searchsorted(at, hi, "right") - 1])
            parting = np.flatnonzero(blanks[data[max(lo, start) : hi]])
            cut = max(start, max(lo, start) + int(parting[-1]) + 1 if len(parting) else 0)
            if cut > lo:
                hi = cut
                break
            hi = min(hi + WINDOW, end)
        block = data[lo:hi]
        blank = blanks[block]
        begins = ~blank
        begins[1:] &= blank[:-1]
        own = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        begins[own[~blank[own]]] = True
        begin = np.flatnonzero(begins)
        if len(begin):
            power, inverse = _power_tables(max(WINDOW, hi - lo))
            value = _VALUE[block]
            value[blank] = 0
            value *= power[: hi - lo]
            total = np.add.reduceat(value, begin)  # blanks after a word add nothing
            first.append(begin + lo)
            hashes.append(mix(total * inverse[begin]))
        lo = hi
    if not first:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(first), at)


#: Words of ASCII letters and digits and of all characters beyond ASCII.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def shingles(column: pa.Array | pa.ChunkedArray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of k words, in order and with repetitions, and where each text's begin, with the end.

    A text of fewer words has one shingle of them all; one without words has none.
    """
    word, at = words(column)
    counts = np.diff(at)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    if len(word) >= k:
        full = np.zeros(len(word) - k + 1, U)
        for i in range(k):
            full += word[i : len(word) - k + 1 + i] * _MIX[i]
        full = mix(full)
    else:
        full = np.zeros(0, U)
    starts = np.repeat(at[:-1] - out_at[:-1], sizes) + np.arange(out_at[-1])
    long = np.repeat(counts >= k, sizes)
    out = np.zeros(out_at[-1], U)
    out[long] = full[starts[long]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = word[at[i] : at[i + 1]]
        out[out_at[i]] = mix((own * _MIX[: len(own)]).sum(dtype=U, keepdims=True) + _MIX[k + len(own)])[0]
    return out, out_at


def parts(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes in one column, or one row; an empty batch as it is."""
    values = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    begin = 0
    while begin < batch.num_rows or not batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1) if batch.num_rows else 0
        yield batch.slice(begin, end - begin)
        if not batch.num_rows:
            return
        begin = end


def slices(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20) -> Iterator[pa.Array]:
    """The column in pieces of at most so many bytes of text, or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at = text_bytes(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield column.slice(begin, end - begin)
        begin = end


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for piece in slices(column):
        hashes, at = shingles(piece, k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(hashes[a:b])
