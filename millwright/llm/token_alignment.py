"""Aligning the tokens of two tokenizers over the same bytes, by skipping along diagonals.

Both tokenizers cut the same bytes, so a text's tokens are two ascending lists of end offsets. Where the lists run
one to one, equal ends keep the same distance of their places (the shift): slices of doubling length are compared at the
present shift and the run's end is found by halving, so long stretches cost few comparisons. Where they part, the end
that is behind moves on until both meet again: an irregular group, which changes the shift. Every common end cuts.

Pairs of tokens that end together are counted over the whole corpus. A block of texts sends each of its distinct pairs
once, gets back the pair's count, and looks its links up in these, so what is exchanged are blocks' vocabularies of pairs
and not tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millwright.functions.storage import materialize
from millwright.llm.text import chunks

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose pairs are exchanged as one block, and of text that is cut into tokens at a time.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 512 << 10
#: How the byte-level tokenizers of this kind split a text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer(NamedTuple):
    """``encode`` gives the token ids of texts, ``pieces`` the bytes of each id; ``lead``: it adds a leading space itself."""

    encode: Callable[[list[str]], list]
    pieces: list[bytes]
    lead: bool

    def ids(self, texts: list[str]) -> list:
        """Token ids of a space and the text; strings of special tokens are plain text."""
        return self.encode(texts if self.lead else [f" {t}" for t in texts])


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def byte_level(path: str = BYTE_BPE) -> Tokenizer:
    """A byte-level vocabulary file.

    If its merges are in the order of their ids, ids rank the merges and the quicker of the two libraries gives the same
    tokens; otherwise the file's own library reads it.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, alphabet = spec["model"], _byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(alphabet[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        pieces[k] = token
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if merged == sorted(merged) and spec["normalizer"] is None and plain.items() <= (spec["pre_tokenizer"] or {}).items():
        import tiktoken

        encoding = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return Tokenizer(lambda texts: [encoding.encode_to_numpy(t) for t in texts], pieces, False)
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return Tokenizer(lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)], pieces, False)


@cache
def sentence_pieces(path: str = PIECES) -> Tokenizer:
    """A sentencepiece model: U+2581 is a space, a byte piece its byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    pieces = [bytes([int(n[3:5], 16)]) if model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
    return Tokenizer(lambda texts: model.encode(texts, num_threads=1), pieces, True)


def common_runs(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(places in a, places in b, lengths) of the runs of common values of two ascending lists that end alike."""
    i, j, n = 0, 0, len(a)
    in_a, in_b, lengths = [], [], []
    while i < n:
        end_a, end_b = a[i], b[j]
        while end_a != end_b:  # an irregular group: who is behind moves on
            if end_a < end_b:
                i += 1
                end_a = a[i]
            else:
                j += 1
                end_b = b[j]
        found, step = 1, 1
        while (probe := a[i + found:i + found + step]) and probe == b[j + found:j + found + step]:
            found += len(probe)
            step *= 2
        while step > 1:  # the run ends inside the probe that failed
            step >>= 1
            if (probe := a[i + found:i + found + step]) and probe == b[j + found:j + found + step]:
                found += len(probe)
        in_a.append(i)
        in_b.append(j)
        lengths.append(found)
        i, j = i + found, j + found
    return in_a, in_b, lengths


class Aligned(NamedTuple):
    """Token ids of a text under both tokenizers, and the place of each group's last token in either."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


_NOTHING = Aligned(*(np.zeros(0, np.int64) for _ in range(4)))


class Aligner:
    """Aligns texts under two tokenizers.

    Ids in a list are compared with the text byte by byte; ids in an array come from merges of the text's own bytes, so
    their number of bytes is enough.
    """

    def __init__(self, first: Tokenizer, second: Tokenizer):
        self.first, self.second = first, second
        self.lengths = [np.array([len(p) for p in t.pieces], np.int64) for t in (first, second)]

    def align(self, texts: list[str | None]) -> Iterator[Aligned]:
        """One alignment for each text; without tokens for a null or empty text or if joined tokens are not the text."""
        whole = [t or "" for t in texts]
        for text, a, b in zip(whole, self.first.ids(whole), self.second.ids(whole)):
            yield self._one(text, a, b) if text else _NOTHING

    def _one(self, text: str, a, b) -> Aligned:
        raw = f" {text}".encode()
        sides = []
        for tokenizer, lengths, ids in zip((self.first, self.second), self.lengths, (a, b)):
            if isinstance(ids, list) and b"".join(map(tokenizer.pieces.__getitem__, ids)) != raw:
                return _NOTHING
            ids = np.array(ids, np.int64)
            ends = np.cumsum(lengths[ids])
            if not len(ids) or ends[-1] != len(raw):
                return _NOTHING
            sides.append((ids, ends.tolist()))
        (a, ends_a), (b, ends_b) = sides
        in_a, in_b, length = (np.array(x, np.int64) for x in common_runs(ends_a, ends_b))
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return Aligned(a, b, np.repeat(in_a, length) + inside, np.repeat(in_b, length) + inside)


class GroupText:
    """Writes an alignment's groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size_a: int, size_b: int):
        ends = [(size_a, b",", b"|"), (size_b, b",", b";")]
        self.shift = 2 * size_a
        self.table = np.array([b"%d%s" % (k, end) for size, *both in ends for k in range(size) for end in both])

    def __call__(self, x: Aligned) -> bytes:
        if not len(x.a):
            return b""
        n_a, n_b, n = len(x.a), len(x.b), len(x.last_a)
        code_a, code_b = 2 * x.a, 2 * x.b + self.shift
        code_a[x.last_a] += 1
        code_b[x.last_b] += 1
        sizes_a, sizes_b = np.diff(x.last_a, prepend=-1), np.diff(x.last_b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(n), sizes_a), np.repeat(np.arange(n), sizes_b)
        merged = np.empty(n_a + n_b, np.int64)
        merged[np.arange(n_a) + (x.last_b + 1 - sizes_b)[group_a]] = code_a
        merged[np.arange(n_b) + (x.last_a + 1)[group_b]] = code_b
        return self.table[merged].tobytes().translate(None, b"\0")[:-1]  # shorter entries are padded


def _slices(batches, text_col: str, limit: int):
    for batch in chunks(batches, text_col, limit):
        yield batch, batch.column(text_col).cast(pa.string()).to_pylist()


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = BYTE_BPE, second: str = PIECES) -> DataFrame:
    """(id, a, b, last_a, last_b): token ids of a space and the text under both tokenizers, and each group's last places.

    A text without tokens (null, empty, or not given back by its tokens) has empty arrays. Rows stay where they are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, arrow = dict(rows.dtypes)["id"], to_arrow_schema(rows.select("id").schema).field(0).type
    names = ["a", "b", "last_a", "last_b"]

    def run(batches):
        aligner = Aligner(byte_level(first), sentence_pieces(second))
        for batch, texts in _slices(batches, "text", SLICE_BYTES):
            columns = zip(*aligner.align(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow), *(pa.array(list(c), pa.list_(pa.int32())) for c in columns)], ["id", *names])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} array<int>" for n in names))


class _Block:
    """The pairs of some texts and how often each is linked."""

    def __init__(self, number: int):
        self.number, self.bytes, self.parts = number, 0, []

    def add(self, pairs: np.ndarray, size: int) -> None:
        self.parts.append(np.unique(pairs, return_counts=True))
        self.bytes += size

    def batch(self, names) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (keys, counts)]
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *lists], names)


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = BYTE_BPE, second: str = PIECES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    Links are pairs of tokens that end together, one for each group. A pair's count is how many links of all rows hold
    it; ``n_best`` counts a row's links whose count is the highest of their second token's, ties included, ``count_sum`` adds
    up the counts of the row's links. ``groups_sha256`` is the digest of the groups as ``GroupText`` writes them, empty
    without tokens. Null and empty texts, and texts that their tokens do not give back, have zeros; null ids and
    repeated rows are rows like others; an empty table gives no rows; further columns are not read. A text of any
    length is one row of one task; blocks of texts are bounded by ``BLOCK_BYTES``, or one text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, arrow = dict(rows.dtypes)["id"], to_arrow_schema(rows.select("id").schema).field(0).type
    size_b = len(sentence_pieces(second).pieces)
    code = np.int32 if len(byte_level(first).pieces) * size_b < 1 << 31 else np.int64
    own = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "block"]
    names = [*own, "pairs", "counts"]

    def run(batches):
        aligner = Aligner(byte_level(first), sentence_pieces(second))
        write = GroupText(len(aligner.first.pieces), size_b)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)

        def closed():
            tail = block.batch(["block", "pairs", "counts"])
            nothing = [pa.nulls(1, arrow), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([*nothing, *tail.columns], names)

        for batch, texts in _slices(batches, "text", SLICE_BYTES):
            if block.bytes >= BLOCK_BYTES:
                yield closed()
                number += 1
                block = _Block(number)
            found, n = [], len(texts)
            for x in aligner.align(texts):
                pairs = x.a[x.last_a] * size_b + x.b[x.last_b]
                found.append((len(x.a), len(x.b), len(pairs), hashlib.sha256(write(x)).hexdigest() if len(x.a) else "", pairs.astype(code).tobytes()))
            columns = list(zip(*found))
            block.add(np.frombuffer(b"".join(columns[4]), code), sum(len(t or "") for t in texts))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            empty = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(arrow), *(pa.array(c, t) for c, t in zip(columns, types)), pa.array([number] * n, pa.int64()), empty, empty], names
            )
        if block.parts:
            yield closed()

    schema = f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, block long, pairs array<long>, counts array<long>"
    written = materialize(rows.mapInArrow(run, schema), "token-links")
    texts = written.where("pairs IS NULL").select(*own)
    blocks = written.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    blocks = blocks.select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = materialize(blocks.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    second_token = (F.col("pair") % size_b).alias("token")
    highest = counts.groupBy(second_token).agg(F.max("count").alias("highest"))
    judged = counts.withColumn("token", second_token).join(highest, "token").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = blocks.select("block", "pair").join(judged, "pair").select(F.col("block").alias("of"), "pair", "count", "best")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, count, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(keys)
        keys, count, best = keys[order], count[order], best[order].astype(np.int64)
        n_best, total = [], []
        for links in left.column("links"):
            at = np.searchsorted(keys, np.frombuffer(links.as_buffer(), code).astype(np.int64))
            n_best.append(int(best[at].sum()))
            total.append(int(count[at].sum()))
        columns = [left.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_groups")]
        return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left.column("groups_sha256")],
                        ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(look_up, out)
