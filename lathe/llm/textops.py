"""Column-at-a-time text helpers shared by the operators of this package (Arrow and numpy, no per-row Python)."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a Python worker: bounds memory, changes no result.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def map_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable:
    """A ``mapInArrow`` function that applies ``f`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield f(batch)
        release()

    return run


def release() -> None:
    """Give freed memory back at the end of a task: workers are used again and would keep the peak of every task before."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space separated words: (word index per occurrence, offsets per text, distinct words).

    Null and blank texts have no words.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    ids = np.asarray(coded.indices, dtype=np.int32)
    uniq = coded.dictionary.to_pylist()
    if "" in uniq:
        blank = uniq.index("")
        keep = ids != blank
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, ids = before[offsets], ids[keep]
    return ids, offsets, uniq


#: Letters of scripts that put no spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U000323af"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_UNITS = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")


def units(ids: np.ndarray, offsets: np.ndarray, uniq: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What ``words`` gives, with words cut around every letter of a script that has no spaces."""
    cut = [i for i, u in enumerate(uniq) if not u.isascii() and _ANY_UNSPACED.search(u)]
    if not cut:
        return ids, offsets, uniq
    known: dict[str, int] = {u: i for i, u in enumerate(uniq)}
    parts = [[i] for i in range(len(uniq))]
    for i in cut:
        parts[i] = [known.setdefault(u, len(known)) for u in _UNITS.findall(uniq[i])]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((k for p in parts for k in p), np.int32, int(counts.sum()))
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = counts[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], n)], ends[offsets], list(known)


def word_hashes(uniq: list[str]) -> np.ndarray:
    """The first eight bytes of each word's MD5, as unsigned 64-bit integers (any engine can compute them)."""
    md5 = hashlib.md5
    joined = b"".join(md5(w.encode("utf-8", "surrogatepass")).digest()[:8] for w in uniq)
    return np.frombuffer(joined, dtype=">u8").astype(np.uint64)


def shingle_hashes(ids: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of each text; a text of fewer words is one shingle of all its words.

    A shingle's hash is ``mix(sum(C[i] * h[i]) mod 2**64)``.
    """
    h = hashes[ids]
    lengths = np.diff(offsets)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    owner_shift = offsets[:-1] - starts[:-1]
    at = np.arange(starts[-1], dtype=np.int64) + np.repeat(owner_shift, counts)
    total = np.zeros(len(at), dtype=np.uint64)
    last = len(h) - 1
    width = np.repeat(np.minimum(lengths, n), counts)
    short = bool((lengths < n).any())
    with np.errstate(over="ignore"):
        for i in range(n):
            part = h[np.minimum(at + i, last)] * np.uint64(MULTIPLIERS[i % len(MULTIPLIERS)] + 2 * (i // len(MULTIPLIERS)))
            if short:
                part = np.where(width > i, part, np.uint64(0))
            total += part
    return mix(total), starts


MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
MIX = 0xFF51AFD7ED558CCD


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(MIX)
        return x ^ (x >> np.uint64(29))


def per_owner(f: np.ufunc, values: np.ndarray, starts: np.ndarray, empty) -> np.ndarray:
    """``f.reduceat`` over the runs that ``starts`` bounds; runs without values get ``empty``."""
    counts = np.diff(starts)
    out = np.full(len(counts), empty, dtype=values.dtype)
    some = counts > 0
    if some.any():
        out[some] = f.reduceat(values, starts[:-1][some])
    return out


def ragged(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, type=kind))
