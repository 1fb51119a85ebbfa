"""Words, shingles and rolling hashes, as small numpy helpers used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Multiplier of the rolling hash, and the two multipliers that finish it.
BASE, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Each text as UTF-8 bytes, a null as empty bytes."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of anything but space, tab, LF, VT, FF and CR, which is what bytes.split() separates at."""
    return text.split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k entries, by doubling: about log2(k) passes over the array."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, part = BASE, 1, h
    done, covered = None, 0
    left = k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done = part
                else:
                    m = len(h) - covered - width + 1
                    done = done[:m] * power + part[covered : covered + m]
                covered += width
            left >>= 1
            if left:
                m = len(h) - 2 * width + 1
                part = part[:m] * power + part[width : width + m]
                power = power * power
                width *= 2
        return mixed(done[:n])


def sliding_argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest entry (the last of equal ones) in each window of w entries."""
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(g))
    width = 1
    while width < w:
        step = min(width, w - width)
        a, b = best[:-step], best[step:]
        best = np.where(g[b] <= g[a], b, a)
        width += step
    return best[:n]


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64, copy=False).view(np.int64)


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; a text of 1 to n-1 words has one shingle, an empty one none."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(tokens), min(n, len(tokens))))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that a task holds few texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(make(batch.slice(at, rows)))

    return df.mapInArrow(run, schema)
