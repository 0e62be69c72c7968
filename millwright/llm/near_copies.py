"""Near copies by the resemblance of their word shingles, found through SimHash fingerprints.

Texts with the same words are one class. Candidates of different words come from two kinds of fingerprints: those of
whole texts, linked by the pigeonring filter, and those of parts of a text. A part is what a hash picks of its distinct
shingles, four or five of them; few edits leave many parts of a text as they were, while a fingerprint of the whole
moves by more bits than any selective filter allows (a resemblance of 0.8 is about ten of 64). Short texts have too few
parts for that; theirs are all pairs of the first shingles in the order of their hashes, of which similar sets always
have one in common. Sharing a fingerprint is checked on the full shingle sets, so nothing below the wanted resemblance
is ever linked.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.functions.storage import materialize
from millwright.llm.components import components
from millwright.llm.line_dedup import unused
from millwright.llm.simhash import fingerprint_bits, links, shingle_hashes
from millwright.llm.text import chunks, mix, pair

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles of a part at most, on average, and parts taken of a text.
PART_SHINGLES, PARTS = 6, 24
#: Sets of up to so many shingles meet by pairs of their first shingles, without loss.
SHORT = 40
#: Of a key with groups still apart, so many neighbours are compared in the first round, which joins most that belong
#: together; each round takes so many times more.
ROUND, GROWTH = 16, 1 << 20
#: Words of 64 bits in the bitmap of a set's hashes: what one set has and the other lacks there bounds their similarity.
BITMAP = 16


def _class(text: bytes | None) -> str:
    """What texts with the same lower-case words have in common: 128 bits."""
    return xxhash.xxh3_128_hexdigest(b" ".join((text or b"").lower().split()))


def _pair_keys(distinct: np.ndarray, similarity: float) -> list[int]:
    """One key for each pair of the first shingles of a set, by the order of their scrambled hashes.

    Of a set of n, a similar one holds at least ``similarity`` * n = m. Without the last m - 2 of either set, the two
    still have the first two common shingles in common.
    """
    held = math.ceil(similarity * len(distinct) - 1e-9)
    first = np.sort(mix(distinct))[: len(distinct) - max(held, 1) + 2]
    if held < 2:
        return list(first)
    left, right = np.array(list(combinations(range(len(first)), 2))).T
    return list(pair(first[left], first[right]))


def _keys(distinct: np.ndarray, similarity: float) -> list[int]:
    """Two sets that resemble each other are both short enough for pairs, or both long enough for parts."""
    short = _pair_keys(distinct, similarity) if len(distinct) * similarity <= SHORT else []
    return short + (_part_keys(distinct, similarity) if len(distinct) > SHORT else [])


def _part_keys(distinct: np.ndarray, similarity: float) -> list[int]:
    """Fingerprints of the parts of a set of shingle hashes, each mixed with its place.

    Sets that resemble each other differ in size by at most ``similarity``: taking the partition of one's own size and
    that of the largest similar set, such sets have a partition in common.
    """
    keys = []
    scrambled = mix(distinct)
    sizes = {1 << max(0, math.ceil(math.log2(len(distinct) * grown / PART_SHINGLES))) for grown in (1, 1 / similarity)}
    for n_parts in sorted(sizes):
        part = scrambled & np.uint64(n_parts - 1)
        taken = np.flatnonzero(part < PARTS)
        order = taken[np.argsort(part[taken], kind="stable")]
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for members in np.split(order, edges):
            if len(members):
                fp = np.array([fingerprint_bits(distinct[members])], np.uint64)
                keys.append(pair(fp, np.array([n_parts * PARTS + int(part[members[0]])], np.uint64))[0])
    return keys


def _bitmap(distinct: np.ndarray) -> np.ndarray:
    """Which of the bitmap's places the hashes of a set fall on."""
    places = np.zeros(64 * BITMAP, bool)
    places[(distinct % np.uint64(64 * BITMAP)).astype(np.int64)] = True
    return np.packbits(places).view(np.int64)


def _can_resemble(similarity: float, words: int):
    """Whether sets of ``n_x`` and ``n_y`` can be similar enough, by the first so many words of their bitmaps.

    Each place that only one set has is a shingle of that set which the other one lacks, so similar sets always pass.
    """
    def lacking(a, b):
        return sum((F.bit_count(F.col(f"bits{k}_{a}").bitwiseAND(F.bitwise_not(F.col(f"bits{k}_{b}")))) for k in range(words)), F.lit(0))

    common = F.least(F.col("n_x") - lacking("x", "y"), F.col("n_y") - lacking("y", "x"))
    return common * (1 + similarity) >= similarity * (F.col("n_x") + F.col("n_y")) - 1e-6


def _sketches(docs: DataFrame, id_type: str, shingle: int, similarity: float) -> DataFrame:
    """(id, mark, same, fp, n, bits, keys) of (id, mark, text) rows; ``n`` distinct shingles and their bitmap."""

    def run(batches):
        for batch in chunks(batches):
            same, fps, sizes, bits, keys = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashed = shingle_hashes(text or b"", shingle)
                same.append(_class(text))
                fps.append(fingerprint_bits(hashed) if len(hashed) else 0)
                distinct = np.unique(hashed)
                sizes.append(len(distinct))
                bits.append(_bitmap(distinct))
                keys.append(np.array(_keys(distinct, similarity) if len(hashed) else [], np.uint64).view(np.int64))
            columns = [
                batch.column("id"), batch.column("mark"), pa.array(same), pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "same", "fp", "n", "bits", "keys"])

    return docs.mapInArrow(run, f"id {id_type}, mark long, same string, fp long, n int, bits array<long>, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(same, shingles): the sorted distinct shingle hashes of (text, same) rows whose text is of that class."""

    def run(batches):
        for batch in chunks(batches):
            same, sets = [], []
            for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("same").to_pylist()):
                if _class(text) == wanted:
                    same.append(wanted)
                    sets.append(np.unique(shingle_hashes(text or b"", shingle)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.string()), pa.array(sets, pa.binary())], ["same", "shingles"])

    return docs.mapInArrow(run, "same string, shingles binary")


def _resembling(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the (a, b, left, right) rows whose shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                if len(x) + len(y) and min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both))
                else:
                    keep.append(False)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a string, b string")


def _named(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """``classes`` with the component of each."""
    member = components(linked).withColumnRenamed("node", "same")
    return classes.join(member, "same", "left").withColumn("component", F.coalesce("component", "same"))


def _still_apart(crowds: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of keys whose classes are in several components; ``main`` marks those in the key's largest one."""
    at = _named(crowds, linked)
    sizes = at.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("largest")).where("parts > 1")
    at = at.join(largest.select("key", F.col("largest.component").alias("of_main")), "key")
    return at.select("key", "same", "n", "place", "members", "component", (F.col("component") == F.col("of_main")).alias("main"))


def _pairs_between(apart: DataFrame, first: int, last: int, similarity: float) -> DataFrame:
    """(a, b): each class outside its key's largest component with those ``first`` to ``last`` places away, round the key.

    The distance is the same from both sides, so it doesn't matter which one is the largest now or later. Pairs inside a
    component are left out, and those whose sizes or bitmaps alone tell them apart.
    """
    bits = [F.col("bits")[k].alias(f"bits{k}") for k in range(BITMAP)]
    apart = apart.select("key", "same", "n", "place", "members", "component", "main", *bits)
    near, far = (apart.select("key", *(F.col(c).alias(f"{c}_{side}") for c in apart.columns if c != "key")) for side in "xy")
    steps = F.abs(F.col("place_y") - F.col("place_x"))
    steps = F.least(steps, F.col("members_x") - steps)
    sizes = F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y")
    both = near.where("not main_x").join(far, "key").where(steps.between(first, last) & (F.col("component_x") != F.col("component_y")) & sizes)
    both = both.where(_can_resemble(similarity, BITMAP // 2) & _can_resemble(similarity, BITMAP))
    return both.select(F.least("same_x", "same_y").alias("a"), F.greatest("same_x", "same_y").alias("b")).distinct()


def near_copy_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, mark, first) for every row: its text's hash, and the smallest (id, mark) of its group.

    Groups are connected by texts of the same words and by pairs whose sets of ``shingle``-word shingles (the whole
    text, if shorter) have a Jaccard similarity of at least ``similarity``. Every class with a shared fingerprint is
    compared with the first and the last class that share it. Then only fingerprints whose classes are still in several
    groups count: rounds of more and more neighbours compare their classes across groups, until every two classes that
    share a fingerprint are in one group or were compared. Null and blank texts are one group. A null id takes part
    and is the smallest. Repeated rows are repeated; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    sketches = materialize(_sketches(rows, id_type, shingle, similarity), "sketches")
    classes = materialize(
        sketches.groupBy("same").agg(
            F.min(F.struct("id", "mark")).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"),
            F.first("keys").alias("keys"),
        ), "classes"
    )
    whole = F.array(F.xxhash64(F.lit("whole"), "fp"))
    keyed = classes.select("same", "n", F.explode(F.concat("keys", whole)).alias("key"))
    of_key = Window.partitionBy("key")
    crowds = materialize(
        keyed.withColumn("place", F.row_number().over(of_key.orderBy("same"))).withColumn("members", F.count("*").over(of_key)).where("members > 1"), "crowds"
    )
    shared = crowds.groupBy("key").agg(F.min("same").alias("low"), F.max("same").alias("high"))
    asked = crowds.join(shared, "key").select("same", F.explode(F.array("low", "high")).alias("other")).where("same <> other")
    pairs = asked.select(F.least("same", "other").alias("a"), F.greatest("same", "other").alias("b"))
    of_fp = classes.groupBy("fp").agg(F.min("same").alias("same"))
    near = links(of_fp.select("fp"))
    near = near.join(of_fp.select(F.col("fp").alias("a"), F.col("same").alias("sa")), "a").join(
        of_fp.select(F.col("fp").alias("b"), F.col("same").alias("sb")), "b"
    )
    pairs = materialize(pairs.union(near.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))).distinct(), "candidates")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct()
    source = classes.join(asked, "same").select(F.col("first.id").alias("w_id"), F.col("first.mark").alias("w_mark"), "same")
    texts = rows.join(source, rows["id"].eqNullSafe(source["w_id"]) & (rows["mark"] == source["w_mark"])).select("text", "same")
    sets = materialize(_sets(texts, shingle).dropDuplicates(["same"]), "shingle-sets")
    left, right = (sets.select(F.col("same").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "left"), ("b", "right")))
    linked = materialize(_resembling(pairs.join(left, "a").join(right, "b"), similarity), "copies")

    done, step, found = 0, ROUND, True
    while True:
        if found:
            crowds = apart = materialize(_still_apart(crowds.select("key", "same", "n", "place", "members"), linked), "apart")
        most = apart.agg(F.max("members")).first()[0] or 0
        if done >= most // 2:
            break
        between = materialize(_pairs_between(apart.join(classes.select("same", "bits"), "same"), done + 1, done + step, similarity), "candidates")
        more = materialize(_resembling(between.join(left, "a").join(right, "b"), similarity), "copies")
        found = not more.isEmpty()
        linked = linked.union(more) if found else linked
        done, step = done + step, step * GROWTH

    named = _named(classes.select("same", "first"), linked)
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").select("same", F.col("least").alias("first"))
    return sketches.select("id", "mark", "same").join(named, "same").select("id", "mark", "first")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that are the first of their group of near copies: one row of each group.

    Rows that agree in id and text count as one. All columns are kept, whatever their names; an empty table stays empty.
    """
    mark, of, its = (unused(n, docs.columns) for n in ("mark", "of", "its"))
    first = near_copy_groups(docs, shingle, similarity, id_col, text_col).select(
        F.col("first.id").alias(of), F.col("first.mark").alias(its)
    ).distinct()
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    mine = marked[id_col].eqNullSafe(first[of]) & (marked[mark] == first[its])
    return marked.join(first, mine, "left_semi").dropDuplicates([id_col, mark]).select(*docs.columns)
