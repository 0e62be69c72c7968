"""Benchmark decontamination by latent semantic retrieval.

Passages (word windows of a few lengths) and benchmark items are TF-IDF vectors over hashed words, folded into the
space of the leading right singular vectors, each divided by its singular value. The vectors come from a randomised
SVD over the passages of all documents, whose hashed words are written once for it; so do the word statistics.
Item and passage pairs with a high cosine are checked exactly: the longest common subsequence must hold most of the
item, and enough of its last part, where the answer stands. Reordered or padded copies of an item so pass as well as
exact ones, and passages that merely share common words do not.

Items of a few words are too short for a latent vector; they are sought word for word.

Benchmark items are the queries: they go over the documents in blocks of bounded size.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millwright.functions.storage import materialize
from millwright.llm.text import chunks, hashes, mix, words

TERM_BITS = 16
TERMS = 1 << TERM_BITS
#: Latent dimensions, and those more that the random projection carries.
DIMS, SPARE = 64, 8
#: Words of a passage that the singular vectors are fitted on.
SAMPLE_WINDOW = 32
POWER_ROUNDS = 1
#: Window lengths; an item is sought in windows of the length nearest to its own.
SCALES = (8, 12, 16, 24, 32, 48, 64)
STEP = 4
#: Pairs from this cosine on are candidates; of those the window must hold this share of the item's words in any order.
COSINE, SHARED = 0.5, 0.5
#: Shares of the item, and of its last third, that the common subsequence must hold.
OVERLAP, ANSWER_OVERLAP = 0.7, 0.5
#: Items with fewer words must stand in a text word for word.
MIN_ITEM_WORDS = 8
#: Items sought in one pass over the documents, about.
ITEM_BLOCK = 2000
PIECE = SCALES[-1]
#: Bytes of stored words (two a word) that are turned into passages at a time, and rows gathered at a time.
_PASSAGE_BYTES = 2 << 20
_GATHER = 2048
_SEARCH_WORDS = 8 << 10
#: Item word codes are folded to this many columns for the first look at shared words; code 0 is no item's word.
_FOLD = 4096


def _terms(distinct: pa.Array) -> np.ndarray:
    return (mix(hashes(distinct)) >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _termed(docs: DataFrame) -> DataFrame:
    """Each row's hashed words in their order, two bytes a word; a null text has none."""

    def run(batches):
        for batch in chunks(batches):
            codes, starts, distinct = words(batch.column("text"))
            terms = _terms(distinct).astype(np.uint16)[codes]
            buffers = [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(terms)]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(starts) - 1, buffers)], ["terms"])

    return docs.select("text").mapInArrow(run, "terms binary")


def _stored_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words of all rows, first word of each row and the end)."""
    column = batch.column("terms").cast(pa.binary())
    starts = np.zeros(len(column) + 1, np.int64)
    np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) // 2, out=starts[1:])
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16), starts


def document_frequencies(termed: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all rows have each hashed word, and how many rows there are."""

    def run(batches):
        total = np.zeros(TERMS + 1, np.int64)
        for batch in chunks(batches, "terms"):
            terms, starts = _stored_terms(batch)
            total[TERMS] += batch.num_rows
            if not len(terms):
                continue
            order = np.argsort(terms, kind="stable")  # a word's rows follow one another, in their order
            ordered, owner = terms[order], np.repeat(np.arange(len(starts) - 1), np.diff(starts))[order]
            new = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])))
            total[:TERMS] += np.bincount(ordered[new], minlength=TERMS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    rows = _few_tasks(termed).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    result = np.zeros(TERMS + 1, np.int64)
    result[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return result[:TERMS], int(result[TERMS])


def _few_tasks(termed: DataFrame) -> DataFrame:
    """The same rows in tasks as many as the cores, twice: each task sends one matrix or count of all words, whatever it read."""
    return termed.coalesce(2 * termed.sparkSession.sparkContext.defaultParallelism)


def _passages(batch: pa.RecordBatch, idf: np.ndarray):
    """(words of each passage, blank places filled with ``TERMS``; words; passage of each word; passages' TF-IDF lengths)."""
    terms, starts = _stored_terms(batch)
    lengths = np.diff(starts)
    n = -(-lengths // SAMPLE_WINDOW)
    place = np.arange(len(terms)) + np.repeat((np.cumsum(n) - n) * SAMPLE_WINDOW - starts[:-1], lengths)
    slots = np.full(int(n.sum()) * SAMPLE_WINDOW, TERMS, np.int32)
    slots[place] = terms
    slots = slots.reshape(-1, SAMPLE_WINDOW)
    if not len(slots):
        return slots, terms, place, np.zeros(0, np.float32)
    # a word's repeats add up, so the length is over a passage's distinct words
    ordered = np.sort(slots, axis=1)
    new = np.ones(slots.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.flatnonzero(new)
    value = np.diff(np.append(first, slots.size)) * idf[ordered.ravel()[first]]
    square = np.add.reduceat(value.astype(np.float64) ** 2, np.searchsorted(first, np.arange(0, slots.size, SAMPLE_WINDOW)))
    return slots, terms, place // SAMPLE_WINDOW, np.maximum(np.sqrt(square), 1e-12).astype(np.float32)


def _projected(slots: np.ndarray, length: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """A @ basis for the unit-length passages; ``weighted`` is the basis times idf, and a row of zeros. Few passages at a time."""
    width, few, ones = weighted.shape[1], _GATHER // SAMPLE_WINDOW, np.ones((1, SAMPLE_WINDOW), np.float32)
    out, buffer = np.empty((len(slots), width), np.float32), np.empty((_GATHER, width), np.float32)
    for begin in range(0, len(slots), few):
        part = slots[begin:begin + few]
        np.take(weighted, part.ravel(), axis=0, out=buffer[:part.size], mode="clip")
        np.matmul(ones, buffer[:part.size].reshape(-1, SAMPLE_WINDOW, width), out=out[begin:begin + few, None])
    out /= length[:, None]
    return out


def _add_back(total: np.ndarray, terms: np.ndarray, passage: np.ndarray, back: np.ndarray) -> None:
    """Adds to each word the rows of its passages, words that occur equally often together."""
    owner = passage[np.argsort(terms, kind="stable")]
    counts = np.bincount(terms, minlength=len(total))
    first = np.cumsum(counts) - counts
    by = np.argsort(counts, kind="stable")
    by = by[np.searchsorted(counts[by], 1):]
    sizes, at = np.unique(counts[by], return_index=True)
    width = back.shape[1]
    buffer, sums, done = np.empty((_GATHER, width), np.float32), np.zeros((len(by), width), np.float32), 0
    for size, same in zip(sizes.tolist(), np.split(by, at[1:])):
        step = max(1, _GATHER // size)
        for begin in range(0, len(same), step):
            some = same[begin:begin + step]
            for skip in range(0, size, _GATHER):  # a word that fills the buffer alone, in parts
                n = min(size - skip, _GATHER)
                rows = owner[first[some][:, None] + np.arange(skip, skip + n)].ravel()
                np.take(back, rows, axis=0, out=buffer[:len(rows)], mode="clip")
                sums[done:done + len(some)] += np.matmul(np.ones((1, n), np.float32), buffer[:len(rows)].reshape(len(some), n, width))[:, 0]
            done += len(some)
    total[by] += sums


def _weighted(idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return np.vstack([basis * idf[:TERMS, None], np.zeros((1, basis.shape[1]), np.float32)])


def _product(termed: DataFrame, idf: np.ndarray, basis) -> np.ndarray:
    """Sum of A^T (A basis) over the passages of all rows, as slabs of rows that tasks add up."""
    width, slab_bits = DIMS + SPARE if basis is None else basis.shape[1], TERM_BITS - 6
    context = termed.sparkSession.sparkContext
    shared = context.broadcast((idf, basis))

    def run(batches):
        idf, basis = shared.value
        if basis is None:
            basis = np.random.default_rng(7).standard_normal((TERMS, width), np.float32)
        weighted, total = _weighted(idf, basis), np.zeros((TERMS, width), np.float32)
        for batch in chunks(batches, "terms", _PASSAGE_BYTES):
            slots, terms, passage, length = _passages(batch, idf)
            if len(slots):
                _add_back(total, terms, passage, _projected(slots, length, weighted) / length[:, None])
        total *= idf[:TERMS, None]
        for slab in range(1 << (TERM_BITS - slab_bits)):
            part = total[slab << slab_bits:(slab + 1) << slab_bits]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slab", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.float32) for p in table.column("part").to_pylist()]
        return pa.table({"slab": table.column("slab").slice(0, 1), "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    result = np.zeros((TERMS, width), np.float32)
    for row in _few_tasks(termed).mapInArrow(run, "slab long, part binary").groupBy("slab").applyInArrow(add, "slab long, part binary").toLocalIterator():
        result[row["slab"] << slab_bits:(row["slab"] + 1) << slab_bits] = np.frombuffer(row["part"], np.float32).reshape(-1, width)
    shared.destroy()
    return result


def _times(matrix: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The product in single precision, a few rows at a time."""
    out = np.empty((len(matrix), factor.shape[1]), np.float32)
    for begin in range(0, len(matrix), 4096):
        out[begin:begin + 4096] = matrix[begin:begin + 4096].astype(np.float64) @ factor
    return out


def _orthonormal(matrix: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the matrix's, from the small product of the matrix with itself."""
    for _ in range(2):  # the second pass takes out what the first one's rounding leaves
        square = np.zeros((matrix.shape[1],) * 2)
        for begin in range(0, len(matrix), 4096):
            part = matrix[begin:begin + 4096].astype(np.float64)
            square += part.T @ part
        value, vector = np.linalg.eigh(square)
        real = value > 1e-9 * value.max(initial=1e-30)
        matrix = _times(matrix, vector[:, real] / np.sqrt(value[real]))
    return matrix


def _gram(termed: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of (A basis)^T (A basis) over the passages of all rows."""
    width = basis.shape[1]
    shared = termed.sparkSession.sparkContext.broadcast((idf, basis))

    def run(batches):
        idf, basis = shared.value
        weighted, total = _weighted(idf, basis), np.zeros((width, width))
        for batch in chunks(batches, "terms", _PASSAGE_BYTES):
            slots, _, _, length = _passages(batch, idf)
            if len(slots):
                y = _projected(slots, length, weighted).astype(np.float64)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    parts = _few_tasks(termed).mapInArrow(run, "gram binary").collect()
    shared.destroy()
    return sum((np.frombuffer(r["gram"]).reshape(width, width) for r in parts), np.zeros((width, width)))


def _sample(docs: DataFrame, n_rows: int, most: int) -> DataFrame:
    """The texts of at most ``most`` distinct rows, those with the smallest hashes; copies of a row are one."""
    mark = F.xxhash64("id", "text")
    least, every = -(1 << 63), 1 << 64
    upto = min((1 << 63) - 1, least + every * 4 * most // max(1, n_rows))  # few rows pass, whatever the table's size
    rows = docs.select("text", mark.alias("mark")).where("text IS NOT NULL")
    few = rows.where(F.col("mark") <= upto)
    if upto < (1 << 63) - 1 and few.select("mark").distinct().count() < most:  # copies make up most of the table
        few = rows
    chosen = few.select("mark").distinct().orderBy("mark").limit(most)
    return few.join(F.broadcast(chosen), "mark").groupBy("mark").agg(F.first("text").alias("text")).select("text")


def latent_terms(docs: DataFrame, sample_docs: int | None = None) -> np.ndarray:
    """(hashed word, dimension): each word's inverse document frequency times its fold-in coordinates.

    Fitted on the passages of all rows; ``sample_docs`` fits on those of so many distinct rows instead (no query asks for it).
    Words that the rows do not hold have no coordinates of their own; they get random ones of the usual length.
    """
    termed = materialize(_termed(docs), "terms")
    df, n_docs = document_frequencies(termed)
    idf = np.append(np.log1p((n_docs + 1) / (df + 1)), 0).astype(np.float32)  # above zero also for words that every row has
    if sample_docs is not None:
        termed = materialize(_termed(_sample(docs, n_docs, sample_docs).repartition(6)), "passages")
    basis = None
    for _ in range(POWER_ROUNDS + 1):
        basis = _orthonormal(_product(termed, idf, basis))
        if not basis.shape[1]:
            break
    value, vector = np.linalg.eigh(_gram(termed, idf, basis)) if basis.shape[1] else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-value)[:DIMS]
    single = np.sqrt(np.maximum(value[order], 0))
    keep = single > 1e-3 * max(single.max(initial=0), 1e-9)
    latent = np.zeros((TERMS, DIMS), np.float32)
    latent[:, :keep.sum()] = _times(basis, vector[:, order[keep]] / single[keep])
    lengths = np.sqrt(np.einsum("ij,ij->i", latent, latent))
    seen = lengths > 1e-6 * lengths.max(initial=0)
    usual = np.median(lengths[seen]) if seen.any() else 1.0
    rest = np.flatnonzero(~seen)
    latent[rest] = np.random.default_rng(11).standard_normal((len(rest), DIMS), np.float32) * np.float32(usual / math.sqrt(DIMS))
    latent *= idf[:TERMS, None]
    pa.default_memory_pool().release_unused()
    return latent


class _Items:
    """A block of benchmark items, cut into pieces that are each sought at one window length."""

    def __init__(self, rows, latent: np.ndarray):
        self.vocab: dict[str, int] = {}
        self.ids, self.pieces, self.length, self.last = [], [], [], []
        self.short: dict[int, dict[tuple, list]] = {}  # number of words -> item's words -> items
        found: dict[int, list] = {s: [] for s in SCALES}
        if rows:
            codes, starts, distinct = words(pa.array([r[1] for r in rows], pa.string()))
            terms, names = _terms(distinct), distinct.to_pylist()
        for k, (item, _) in enumerate(rows):
            mine = codes[starts[k]:starts[k + 1]]
            if len(mine) < MIN_ITEM_WORDS:
                if len(mine):
                    key = tuple(self.vocab.setdefault(names[c], _code(len(self.vocab))) for c in mine)
                    self.short.setdefault(len(mine), {}).setdefault(key, []).append(item)
                continue
            self.ids.append(item)
            self.length.append(len(mine))
            n = max(1, round(len(mine) / PIECE)) if len(mine) > 1.5 * PIECE else 1
            self.last.append((0, 1))
            for number, part in enumerate(np.array_split(mine, n)):
                vector = latent[terms[part]].sum(axis=0)
                norm = np.linalg.norm(vector)
                scale = min(SCALES, key=lambda s: abs(math.log(s / len(part))))
                mark: dict[int, int] = {}
                coded = [self.vocab.setdefault(names[c], _code(len(self.vocab))) for c in part]
                for bit, c in enumerate(coded):
                    mark[c] = mark.get(c, 0) | 1 << bit
                answer: dict[int, int] = {}
                tail = coded[-max(1, len(coded) // 3):] if number == n - 1 else []
                if tail:
                    self.last[-1] = (number, len(tail))
                for bit, c in enumerate(tail):
                    answer[c] = answer.get(c, 0) | 1 << bit
                found[scale].append(len(self.pieces))
                unit = vector / norm if norm else vector
                self.pieces.append((len(self.ids) - 1, number, len(coded), mark, len(tail), answer, unit))
        self.room: dict = {}
        self.by_scale = {s: self._at_scale(p) for s, p in found.items() if p}

    def _at_scale(self, numbers):
        """(piece numbers, unit vectors as columns, piece by folded word code: is it one of its words, least shared)."""
        holds = np.zeros((len(numbers), _FOLD), bool)
        for row, k in enumerate(numbers):
            holds[row, [c % _FOLD for c in self.pieces[k][3]]] = True
        holds[:, 0] = False
        least = np.array([SHARED * self.pieces[k][2] for k in numbers])
        return np.array(numbers), np.stack([self.pieces[k][6] for k in numbers]).T.copy(), holds, least


def _code(n: int) -> int:
    """The n-th item word's code: never a multiple of the fold, which stands for other words."""
    return n + n // (_FOLD - 1) + 1


def common_subsequence(mark: dict[int, int], n: int, sequence) -> int:
    """Length of the longest common subsequence; ``mark`` has the places of each word among the other ``n``."""
    full = (1 << n) - 1
    row = full
    for word in sequence:
        hit = row & mark.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def _room(room: dict, name, rows: int, width: int) -> np.ndarray:
    """Space for a matrix, the same again for the same name: fresh memory costs more than the sums that fill it."""
    if name not in room or room[name].size < rows * width:
        room[name] = np.empty(rows * width * 5 // 4, np.float32)
    return room[name][:rows * width].reshape(rows, width)


def _windows(terms, starts, latent, wanted, room):
    """For each wanted scale (scale, first word of each window, vectors): sums of blocks of ``STEP`` words.

    The vectors lie in ``room`` and hold until the next scale.

    Every text begins a block and is followed by blank blocks, so no window holds words of two texts.
    """
    lengths = np.diff(starts)
    n_blocks = -(-lengths // STEP)
    blank = SCALES[-1] // STEP - 1
    base = np.cumsum(n_blocks + blank) - (n_blocks + blank)
    total = int((n_blocks + blank).sum()) + blank
    place = np.arange(len(terms)) - np.repeat(starts[:-1], lengths)
    slots = np.full(total * STEP, TERMS, np.int64)  # the row behind the last term is zero
    slots[np.repeat(base * STEP, lengths) + place] = terms
    slots = slots.reshape(total, STEP)
    real = slots[:, 0] < TERMS
    start_word = np.zeros(total, np.int64)
    start_word[real] = np.flatnonzero(place % STEP == 0)
    width, few = latent.shape[1], _GATHER // STEP
    sums, buffer = {STEP: _room(room, STEP, total, width)}, _room(room, "gathered", _GATHER, width)
    for begin in range(0, total, few):
        part, block = slots[begin:begin + few], sums[STEP][begin:begin + few]
        of = np.take(latent, part.ravel(), axis=0, out=buffer[:part.size], mode="clip").reshape(len(part), STEP, -1)
        np.add(of[:, 0], of[:, 1], out=block)
        for k in range(2, STEP):
            block += of[:, k]

    def windows(scale):  # a window is a shorter one and another one behind it
        if scale not in sums:
            head = STEP << ((scale - 1) // STEP).bit_length() - 1
            gap, tail = head // STEP, windows(scale - head)
            n = min(len(windows(head)), len(tail) - gap)
            sums[scale] = np.add(sums[head][:n], tail[gap:gap + n], out=_room(room, scale, n, width))
        return sums[scale]

    for scale in wanted:
        n = len(windows(scale))
        index = np.arange(0, n, max(1, scale // 16))
        index = index[real[index]]
        yield scale, start_word[index], np.take(sums[scale], index, axis=0, out=_room(room, "vectors", len(index), width), mode="clip")


def _sharing(folded, first_words, scale, holds, q, least):
    """Places of the (window, item) pairs whose window has enough of the item's words, whatever their order."""
    for begin in range(0, len(q), 20_000):
        part = slice(begin, begin + 20_000)
        seen = folded[first_words[part, None] + np.arange(scale)]
        shared = holds[q[part, None], seen]
        yield from (begin + np.flatnonzero(shared.sum(axis=1) >= least[q[part]])).tolist()


def _verified(items: _Items, piece: int, region: np.ndarray):
    """(common words, answer's common words) of a piece in a region of coded words."""
    _, _, n, mark, n_tail, answer, _ = items.pieces[piece]
    if len(set(mark).intersection(region)) < OVERLAP * len(mark) * 0.8:
        return 0, 0
    return common_subsequence(mark, n, region), common_subsequence(answer, n_tail, region) if n_tail else 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", cosine: float = COSINE, latent: np.ndarray | None = None) -> DataFrame:
    """(id, item, item_words, cosine, overlap, answer_overlap): each document and benchmark item it holds.

    ``overlap`` is the share of the item's words in the common subsequence, ``answer_overlap`` that of its last third.
    ``item_words`` is the item's length: one of fewer than ``MIN_ITEM_WORDS`` words must stand in the text word for word,
    and weighs little as evidence. Null and blank texts and items match nothing; an item given several times counts
    once; repeated documents are reported each; either table may be empty; further columns of either are not read.
    Items longer than one and a half of the longest window are sought in pieces, whose overlaps add up.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if latent is None:
        latent = latent_terms(rows)
    shared = spark.sparkContext.broadcast(latent)
    queries = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    n_blocks = max(1, -(-queries.count() // ITEM_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    found = None
    for block in range(n_blocks):
        items = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in queries.where(F.col("block") == block).collect()])
        part = rows.mapInArrow(_searcher(items, shared, cosine, to_arrow_type(benchmark.schema[item_col].dataType)), f"id {id_type}, item {item_type}, item_words long, cosine double, overlap double, answer_overlap double")
        found = part if found is None else found.union(part)
    return found


def _searcher(shared_items, shared_latent, threshold, item_type):
    def run(batches):
        items = _Items(shared_items.value, shared_latent.value)
        latent = np.vstack([shared_latent.value, np.zeros((1, shared_latent.value.shape[1]), np.float32)])
        vocab = pa.array(items.vocab, pa.string())
        code = np.append(np.fromiter(items.vocab.values(), np.int64, len(items.vocab)), 0)  # no item's word: 0
        for batch in chunks(batches):
            all_codes, all_starts, distinct = words(batch.column("text"))
            if not len(all_codes) or not (items.pieces or items.short):
                continue
            all_terms = _terms(distinct)
            item_word = code[pc.fill_null(pc.index_in(distinct, vocab), len(vocab)).to_numpy(zero_copy_only=False)]
            names = batch.column("id")
            for first, last in _runs(all_starts):
                starts = all_starts[first:last + 1] - all_starts[first]
                codes = all_codes[all_starts[first]:all_starts[last]]
                coded = item_word[codes]
                best = _best(items, all_terms[codes], coded, starts, latent, threshold) if items.pieces else {}
                rows = [(names[first + doc].as_py(), *row) for doc, row in itertools.chain(_leaks(items, best), _short(items, coded, starts))]
                if rows:
                    kinds = [names.type, item_type, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "item_words", "cosine", "overlap", "answer_overlap"])

    return run


def _runs(starts):
    """Runs of texts of about ``_SEARCH_WORDS`` words."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _SEARCH_WORDS, side="right")) - 1)
        yield first, min(last, n)
        first = last


def _best(items: _Items, terms, coded, starts, latent, threshold) -> dict:
    """(text, item) -> piece -> (common words, answer's common words, cosine) of the best window."""
    best: dict[tuple[int, int], dict[int, tuple]] = {}
    folded = np.concatenate([coded % _FOLD, np.zeros(SCALES[-1], np.int64)]).astype(np.int32)
    for scale, first_words, vectors in _windows(terms, starts, latent, items.by_scale, items.room):
        if not len(first_words):
            continue
        numbers, wanted, holds, least = items.by_scale[scale]
        norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-12)
        vectors /= norms[:, None]
        at, q, value = [], [], []
        for begin in range(0, len(vectors), 4096):
            some = vectors[begin:begin + 4096]
            sims = np.matmul(some, wanted, out=_room(items.room, "sims", len(some), len(numbers)))
            near = np.flatnonzero(sims >= threshold)
            at.append(begin + near // len(numbers))
            q.append(near % len(numbers))
            value.append(sims.ravel()[near])
        at, q, value = np.concatenate(at), np.concatenate(q), np.concatenate(value)
        for k in _sharing(folded, first_words[at], scale, holds, q, least):
            word, piece = int(first_words[at[k]]), int(numbers[q[k]])
            doc = int(np.searchsorted(starts, word, side="right")) - 1
            item, number, n = items.pieces[piece][:3]
            known = best.setdefault((doc, item), {})
            if number in known and known[number][0] == n:
                continue
            region = coded[max(starts[doc], word - n // 2 - STEP):min(starts[doc + 1], word + scale + n // 2 + STEP)]
            common, tail = _verified(items, piece, region[region > 0].tolist())
            if common and common > known.get(number, (0,))[0]:
                known[number] = (common, tail, float(value[k]))
    return best


def _short(items: _Items, coded: np.ndarray, starts: np.ndarray):
    """Rows like those of ``_leaks`` for short items: places where a text has the item's words in a row."""
    for n, wanted in items.short.items():
        runs = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(coded > 0, n).all(axis=1)) if len(coded) >= n else []
        found = {}
        for at in runs:
            key = tuple(coded[at:at + n].tolist())
            if key in wanted:
                doc = int(np.searchsorted(starts, at, side="right")) - 1
                if at + n <= starts[doc + 1]:
                    found[doc, key] = True
        for doc, key in found:
            yield from ((doc, (item, n, 1.0, 1.0, 1.0)) for item in wanted[key])


def _leaks(items: _Items, best: dict):
    """(text, (item, words, cosine, overlap, answer overlap)) of the pairs that hold enough of the item and of its answer."""
    for (doc, item), parts in best.items():
        last, n_tail = items.last[item]
        if last in parts:
            overlap = sum(p[0] for p in parts.values()) / items.length[item]
            answer = parts[last][1] / n_tail
            if overlap >= OVERLAP and answer >= ANSWER_OVERLAP:
                yield doc, (items.ids[item], items.length[item], max(p[2] for p in parts.values()), overlap, answer)
