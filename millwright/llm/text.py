"""Words of whole texts as flat integer arrays, and 64-bit hashes of them.

Helpers for code inside ``mapInArrow``. A word is a run of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); lower-casing touches A-Z only. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a task turns into words at a time.
CHUNK_BYTES = 4 << 20

_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= limit:
            if len(sizes):
                yield batch
            continue
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, first word of each text and the end, distinct words by code)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=starts[1:])
    blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        codes = codes[keep]
        codes -= codes > blank
        distinct = distinct.filter(pc.not_equal(distinct, pa.scalar("", distinct.type)))
    return codes, starts, distinct


def hashes(strings: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of every string."""
    raw = strings.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, raw, repeat(seed)), np.uint64, len(raw))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    values = (values ^ (values >> np.uint64(30))) * _MULTIPLIERS[0]
    values = (values ^ (values >> np.uint64(27))) * _MULTIPLIERS[1]
    return values ^ (values >> np.uint64(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash for each ordered pair of hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def repeats_within(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return found
