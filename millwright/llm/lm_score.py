"""Language-model scores by deleted interpolation.

The probability of a token after its predecessors is a mixture of estimates: the trigram's share of its context (if
trigrams are counted), the bigram's share of its own, the token's share of all tokens, and a uniform one. The mixture weights depend
on how often the context was seen; they are learned by expectation-maximisation on counts deleted from the training
part: the n-grams of one fold of texts are predicted from the counts of the other folds. Scores then use all training
counts.

Counting and looking up are exchanges of hashed n-grams. The corpus is written once as blocks of whole texts (word
codes and word hashes). Every block sends its distinct n-grams, sorted and cut by hash range, to the ranges; a range
adds up the blocks and answers each block with one count per n-gram, in the order they were sent. No task holds more
than a block or a range: blocks are cut at ``BLOCK_TOKENS`` (one longer text is a block of its own) and the number of
ranges follows the number of tokens. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.storage import materialize
from millwright.llm.text import chunks, hashes, mix, pair, words

#: Texts whose id has this crc32 remainder are scored only.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Bigrams are the longest n-grams by default; 3 adds trigrams, at more than twice the exchange.
ORDER = 2
BLOCK_TOKENS = 1_000_000
RANGE_GRAMS = 1_500_000
#: Frequencies 1, 2-3, 4-7, ... of the context of two tokens have their own mixture weights; where it was never seen,
#: those of the context of one token have.
FREQUENCY_BUCKETS = 40
#: Probabilities are binned to this part of a factor of two when the weights are learned.
BINS = 4
EM_ROUNDS = 60
_END, _BEGIN = np.uint64(0x5EED0000000E0D01), np.uint64(0x5EED0000000B0600)
_KINDS = {"other": 0, "deleted": 1, "held": 2}

BLOCK = "block long, kind int, ids array<{id}>, lengths array<int>, vocab binary, codes binary"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _blocks(docs: DataFrame, id_type: str, block_tokens: int) -> DataFrame:
    """The (id, text, kind) rows as blocks of whole texts of one kind."""

    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        open_blocks: dict[int, list] = {}
        filled: dict[int, int] = {}

        def close(kind):
            nonlocal made
            ids, lengths, hashed = zip(*open_blocks.pop(kind))
            filled[kind] = 0
            flat = np.concatenate(hashed)
            vocab, codes = np.unique(flat, return_inverse=True)
            made += 1
            columns = [[base + made], [kind], [list(ids)], [list(lengths)], [vocab.tobytes()], [_packed(codes.astype(np.uint32))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for batch in chunks(batches):
            schema = pa.schema([
                ("block", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(batch.schema.field("id").type)),
                ("lengths", pa.list_(pa.int32())), ("vocab", pa.binary()), ("codes", pa.binary()),
            ])
            codes, starts, distinct = words(batch.column("text"))
            hashed = mix(hashes(distinct))[codes]
            for k, (doc, kind) in enumerate(zip(batch.column("id").to_pylist(), batch.column("kind").to_pylist())):
                mine = hashed[starts[k]:starts[k + 1]]
                open_blocks.setdefault(kind, []).append((doc, len(mine), mine))
                filled[kind] = filled.get(kind, 0) + len(mine) + 1
                if filled[kind] >= block_tokens:
                    yield close(kind)
        for kind in list(open_blocks):
            yield close(kind)

    return docs.mapInArrow(run, BLOCK.format(id=id_type))


class _Grams:
    """The n-grams of a block: tokens with the ends, beginnings, bigrams and trigrams. Odd hashes are tokens."""

    def __init__(self, lengths, vocab: bytes, codes: bytes, order: int):
        self.lengths = np.asarray(lengths, np.int64)
        token = (np.frombuffer(vocab, np.uint64) | np.uint64(1))[_unpacked(codes, np.uint32)]
        ends = np.cumsum(self.lengths)
        n = len(self.lengths)
        # every text: its words, then the end
        self.owner = np.repeat(np.arange(n), self.lengths + 1)
        last = ends + np.arange(n)
        self.first = last - self.lengths
        is_word = np.ones(len(token) + n, bool)
        is_word[last] = False
        tokens = np.full(len(token) + n, _END, np.uint64)
        tokens[is_word] = token
        self.n, self.order = len(tokens), order
        grams = [tokens, np.full(n, _BEGIN, np.uint64), self._after(tokens, np.full(n, _BEGIN), tokens)]
        if order == 3:
            grams.append(self._after(grams[2], np.full(n, _BEGIN), tokens ^ _END))
        grams = np.concatenate(grams)
        self.distinct, self.at, self.count = np.unique(grams, return_inverse=True, return_counts=True)

    def _before(self, values, at_first):
        """What stands one token earlier in the same text."""
        result = np.empty_like(values)
        result[1:] = values[:-1]
        result[self.first] = at_first
        return result

    def _after(self, values, at_first, tokens):
        return pair(self._before(values, at_first), tokens) & ~np.uint64(1)

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each hash range begins among the distinct n-grams, and the end."""
        width = (1 << 64) // ranges + 1
        edges = np.array([min(k * width, (1 << 64) - 1) for k in range(1, ranges)], np.uint64)
        return np.concatenate(([0], np.searchsorted(self.distinct, edges), [len(self.distinct)]))

    def by_token(self, counts: np.ndarray):
        """Counts of each token, its context, the bigram, the context of two tokens, and the trigram."""
        n, texts = self.n, len(self.lengths)
        token, two = counts[self.at[:n]], counts[self.at[n + texts:2 * n + texts]]
        begin = counts[self.at[n:n + texts]]
        if self.order == 2:  # as if no context of two tokens had ever been seen
            return token, self._before(token, begin), two, np.zeros_like(two), np.zeros_like(two)
        return token, self._before(token, begin), two, self._before(two, begin), counts[self.at[2 * n + texts:]]


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the upper ones of a sorted range are nearly constant."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _counted(blocks: DataFrame, ranges: int, order: int) -> DataFrame:
    """(block, part, total, deleted, types): the training and the deleted counts of every n-gram of every block.

    ``types`` adds up to the number of distinct training tokens.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = _Grams(row["lengths"], row["vocab"], row["codes"], order)
                cuts = grams.cuts(ranges)
                parts = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                kind = row["kind"]
                for first in range(0, len(parts), 64):
                    some = parts[first:first + 64]
                    counts = [b"" if kind == _KINDS["held"] else _planes(grams.count[a:b].astype(np.uint32)) for _, a, b in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([p for p, _, _ in some], pa.int64()), pa.array([row["block"]] * len(some), pa.int64()),
                        pa.array([kind] * len(some), pa.int32()),
                        pa.array([_planes(grams.distinct[a:b]) for _, a, b in some], pa.binary()), pa.array(counts, pa.binary()),
                    ], ["part", "block", "kind", "grams", "counts"])

    def add(table: pa.Table) -> pa.Table:
        blocks, kinds = table.column("block").to_pylist(), table.column("kind").to_pylist()
        grams = [_from_planes(g, np.uint64) for g in table.column("grams").to_pylist()]
        sizes = [len(g) for g in grams]
        flat = np.concatenate(grams)
        del grams
        distinct, at = np.unique(flat, return_inverse=True)
        counts = np.concatenate([
            _from_planes(c, np.uint32).astype(np.float64) if c else np.zeros(n) for c, n in zip(table.column("counts").to_pylist(), sizes)
        ])
        deleted = np.repeat(np.array(kinds) == _KINDS["deleted"], sizes)
        total = np.bincount(at, counts, len(distinct)).astype(np.uint32)
        without = np.bincount(at, counts * deleted, len(distinct)).astype(np.uint32)
        types = int(np.count_nonzero((distinct & np.uint64(1) == 1) & (total > 0)))
        ends = np.cumsum(sizes)
        answers = {"total": [], "deleted": []}
        for kind, a, b in zip(kinds, ends - sizes, ends):
            answers["total"].append(_packed(total[at[a:b]]))
            answers["deleted"].append(_packed(without[at[a:b]]) if kind == _KINDS["deleted"] else b"")
        return pa.table({
            "block": pa.array(blocks, pa.int64()), "part": table.column("part"),
            "total": pa.array(answers["total"], pa.binary()), "deleted": pa.array(answers["deleted"], pa.binary()),
            "types": pa.array([types] + [0] * (len(kinds) - 1), pa.int64()),
        })

    sent = blocks.mapInArrow(send, "part long, block long, kind int, grams binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, "block long, part long, total binary, deleted binary, types long")


def _answers(table: pa.Table, column: str) -> np.ndarray:
    order = np.argsort(table.column("part").to_numpy())
    data = table.column(column).to_pylist()
    return np.concatenate([_unpacked(data[k], np.uint32) for k in order]).astype(np.int64)


def _bucket(context: np.ndarray, context_two: np.ndarray) -> np.ndarray:
    """Which mixture weights a token has, by how often its contexts were seen."""
    size = lambda c: np.minimum(np.ceil(np.log2(c + 1.0)), FREQUENCY_BUCKETS - 1).astype(np.int64)
    return np.where(context_two > 0, FREQUENCY_BUCKETS + size(context_two), size(context))


def _shares(counts, n_tokens):
    """The trigram's, the bigram's and the token's maximum-likelihood probabilities."""
    token, context, two, context_two, three = counts
    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0.0)
    return share(three, context_two), share(two, context), token / max(n_tokens, 1)


def _evidence(blocks: DataFrame, counted: DataFrame, kept_tokens: int, order: int) -> pa.Table:
    """How many deleted tokens have each (bucket, binned trigram, bigram and token share)."""
    names = ("bucket", "three", "two", "one")

    def binned(share):
        return np.where(share > 0, np.round(-BINS * np.log2(np.where(share > 0, share, 1))), -1).astype(np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = _Grams(row["lengths"], row["vocab"], row["codes"], order)
        counts = grams.by_token(_answers(right, "total") - _answers(right, "deleted"))
        columns = [_bucket(counts[1], counts[3]), *map(binned, _shares(counts, kept_tokens))]
        found, n = np.unique(np.stack(columns), axis=1, return_counts=True)
        return pa.table({**dict(zip(names, found)), "n": n.astype(np.int64)})

    deleted = blocks.where(F.col("kind") == _KINDS["deleted"])
    answers = counted.where(F.length("deleted") > 0)
    found = deleted.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, ", ".join(f"{k} long" for k in (*names, "n"))
    )
    return found.groupBy(*names).agg(F.sum("n").alias("n")).toArrow()


def mixture_weights(evidence: pa.Table, vocabulary: int) -> np.ndarray:
    """(bucket, [trigram, bigram, token, uniform]) weights by expectation-maximisation.

    A bucket without evidence has the weights that all evidence together gives, but none for an estimate whose context
    it has not seen; without any evidence, the uniform estimate has all the weight.
    """
    bucket, n = (evidence.column(k).to_numpy() for k in ("bucket", "n"))
    binned = np.stack([evidence.column(k).to_numpy() for k in ("three", "two", "one")], axis=1).reshape(-1, 3)
    share = np.concatenate(
        [np.where(binned >= 0, np.exp2(-binned / BINS), 0.0), np.full((len(binned), 1), 1 / (vocabulary + 1))], axis=1
    )

    def learned(share, n):
        weights = np.full(4, 1 / 4)
        for _ in range(EM_ROUNDS):
            part = share * weights
            part *= (n / part.sum(axis=1))[:, None]
            weights = part.sum(axis=0) / n.sum()
        return weights

    if not len(n):
        return np.tile([0.0, 0.0, 0.0, 1.0], (2 * FREQUENCY_BUCKETS, 1))
    result = np.tile(learned(share, n), (2 * FREQUENCY_BUCKETS, 1))
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, edges):
        result[bucket[rows[0]]] = learned(share[rows], n[rows])
    result[:, 3] = np.maximum(result[:, 3], 1e-7)
    result[:FREQUENCY_BUCKETS, 0] = 0.0
    result[0, 1] = 0.0
    return result / result.sum(axis=1, keepdims=True)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS,
          range_grams: int = RANGE_GRAMS, order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learned from the texts whose crc32(id as text) mod 7 is not 2; all are scored. ``base_score`` is the add-one
    unigram log10 probability, ``score`` the mixture's; ``order`` is 2 or 3. A null text is an empty one: a single end token. A null id
    counts as a training row. Repeated rows are counted and scored each. An empty table gives no rows. Where there
    is no training row, scores come from the uniform estimate alone. Other columns of ``docs`` are not read.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    id_type = docs.schema[id_col].dataType.simpleString()
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(0))
    kind = F.when(fold == HELD_OUT, _KINDS["held"]).when(fold == DELETED, _KINDS["deleted"]).otherwise(_KINDS["other"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), kind.alias("kind"))
    blocks = materialize(_blocks(rows, id_type, block_tokens), "lm-blocks")

    tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x) + F.size("lengths")
    sums = {r["kind"]: r["n"] for r in blocks.groupBy("kind").agg(F.sum(tokens).alias("n")).collect()}
    train_tokens = sum(n for k, n in sums.items() if k != _KINDS["held"])
    ranges = max(1, math.ceil(order * sum(sums.values()) / range_grams))
    counted = materialize(_counted(blocks, ranges, order), "lm-counts")
    vocabulary = counted.agg(F.sum("types")).first()[0] or 0
    evidence = _evidence(blocks, counted, sums.get(_KINDS["other"], 0), order)
    weights = mixture_weights(evidence, vocabulary)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = _Grams(row["lengths"], row["vocab"], row["codes"], order)
        counts = grams.by_token(_answers(right, "total"))
        w = weights[_bucket(counts[1], counts[3])]
        log = np.log10(sum(w[:, k] * share for k, share in enumerate(_shares(counts, train_tokens))) + w[:, 3] / (vocabulary + 1))
        token = counts[0]
        base = np.log10((token + 1) / (train_tokens + vocabulary + 1))
        n = len(grams.lengths)
        return pa.table({
            "id": pa.array(row["ids"], left.schema.field("ids").type.value_type),
            "held_out": pa.array([row["kind"] == _KINDS["held"]] * n),
            "n_tokens": grams.lengths + 1,
            "n_known": np.bincount(grams.owner, token > 0, n).astype(np.int64),
            "train_tokens": np.full(n, train_tokens, np.int64),
            "base_score": np.bincount(grams.owner, base, n),
            "score": np.bincount(grams.owner, log, n),
        })

    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

