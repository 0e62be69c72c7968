"""Near duplicates by SimHash fingerprints, with pigeonring filtering of candidate pairs.

A fingerprint of 64 bits is cut into a ring of ``SEGMENTS`` segments. Two fingerprints within ``d`` bits have a
starting segment from which every run of ``l`` consecutive segments differs by at most ``l * d / SEGMENTS`` bits.
The runs whose budget rounds down to zero must be equal: that is the join key, one for each start. The longer runs
prune what the key brings together before the full comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.storage import materialize
from millwright.llm.components import components
from millwright.llm.text import chunks

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Fingerprints that share a key are compared in pairs up to this many; beyond, through common neighbours.
PAIR_BUCKET = 48
_AT_ONCE = 1 << 16


def fingerprint_bits(values: np.ndarray) -> int:
    """The fingerprint of the hashes of a text: a bit is set if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for start in range(0, len(values), _AT_ONCE):
        part = values[start:start + _AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(values)).tobytes(), "big")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles of a text; a shorter text is one shingle."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    of, line = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= size:
        return np.array([of(line, 42)], np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begins = [0, *(spaces[: len(found) - size] + 1).tolist()]
    ends = [*spaces[size - 1:].tolist(), len(line)]
    return np.fromiter((of(line[a:b], 42) for a, b in zip(begins, ends)), np.uint64, len(begins))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row, as a signed long; null and blank texts have zero."""

    def run(batches):
        for batch in chunks(batches):
            values = [
                fingerprint_bits(shingle_hashes(t, shingle)) if t else 0
                for t in batch.column("text").cast(pa.binary()).to_pylist()
            ]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), fp], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _rotated(fp, start: int):
    turned = start * WIDTH
    return fp if not turned else F.shiftleft(fp, turned).bitwiseOR(F.shiftrightunsigned(fp, 64 - turned))


def links(fps: DataFrame, max_distance: int = 2, bucket: int = PAIR_BUCKET) -> DataFrame:
    """Distinct ``fps`` (fp) -> (a, b): links that connect exactly what all pairs within ``max_distance`` bits connect.

    ``max_distance`` is 0, 1 or 2. Keys shared by at most ``bucket`` fingerprints give the pairs that pass the
    chain of budgets. Fingerprints that share a key with more meet at their common neighbours instead: two differ
    by one or two bits exactly if some value is at most one bit from both, and a value has at most 65 such
    neighbours. That is linear in the number of fingerprints, however close together they lie.
    """
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance is 0, 1 or 2")
    fp = F.col("fp")
    exact = max(run for run in range(1, SEGMENTS + 1) if run * max_distance < SEGMENTS)
    keyed = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(s).alias("start"), F.shiftrightunsigned(_rotated(fp, s), 64 - exact * WIDTH).alias("key"), _rotated(fp, s).alias("ring"))
        for s in range(SEGMENTS)
    ))).alias("at")).select("fp", "at.*")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["start", "key"]), "chains")

    few = shared.where(F.col("n") <= bucket)
    left = few.select("start", "key", F.col("fp").alias("a"), F.col("ring").alias("ring_a"))
    right = few.select("start", "key", F.col("fp").alias("b"), F.col("ring").alias("ring_b"))
    differ = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    within = F.col("a") < F.col("b")
    for run in range(exact + 1, SEGMENTS + 1):
        head = F.shiftrightunsigned(differ, 64 - run * WIDTH) if run < SEGMENTS else differ
        within &= F.bit_count(head) <= run * max_distance // SEGMENTS
    same_key = (left["start"] == right["start"]) & (left["key"] == right["key"])
    pairs = left.join(right, same_key & within).select("a", "b")

    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    near = [fp] + [fp.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)]
    if max_distance == 2:
        hubs = crowded.select("fp", F.explode(F.array(*near)).alias("hub")).groupBy("hub")
    else:  # one bit apart: each is the other's neighbour
        hubs = crowded.select("fp", F.explode(F.array(*near[: 1 + 64 * max_distance])).alias("hub"))
        hubs = hubs.join(crowded.select(F.col("fp").alias("hub")), "hub", "left_semi").groupBy("hub")
    if max_distance == 2:
        met = hubs.agg(F.collect_list("fp").alias("all"), F.min("fp").alias("a")).where(F.size("all") > 1)
    else:
        met = hubs.agg(F.collect_list("fp").alias("all"), F.first("hub").alias("a")).where(F.size("all") > 1)
    return pairs.union(met.select("a", F.explode("all").alias("b")).where("a <> b")).distinct()


def near_duplicate_components(
    docs: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
    bucket: int = PAIR_BUCKET,
) -> DataFrame:
    """(id, fp, component_id) for every row; the component's smallest id, over links of at most ``max_distance`` bits.

    Equal fingerprints are one class before any comparison, so copies cost nothing. Null and blank texts have
    fingerprint zero and are linked like any other. Repeated rows are repeated in the result. A null id takes
    part but is never a component's name unless all its members are null. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    member = components(links(classes.select("fp"), max_distance, bucket))
    classes = classes.join(member, classes["fp"] == member["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    names = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(names, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")
