"""Aligned tokens against sets of byte offsets, the vocabulary's own library and a count over all documents."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import tokenizers

from millwright.llm import queries, token_alignment

ALPHABET = ["a", "the ", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "▁", " ", "1999", "...", "don't ", "x" * 30, "\x00", "​", "Zug"]


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.fixture(scope="module")
def both():
    whole = tokenizers.Tokenizer.from_file(token_alignment.BYTE_BPE)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECES)
    return whole, pieces


def brute(texts, both):
    """Rows of the query without ids, from the contract's words."""
    whole, pieces = both
    byte = {c: b for c, b in token_alignment._byte_alphabet().items()}
    rows, links = [], []
    for text in texts:
        nothing = (0, 0, 0, "", [])
        if not text:
            rows.append(nothing)
            continue
        a, b = whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        bytes_a = [bytes(byte[c] for c in whole.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(n[3:5], 16)]) if pieces.is_byte(k) else n.replace("▁", " ").encode() for k, n in ((k, pieces.id_to_piece(k)) for k in b)]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append(nothing)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts, start, groups, mine = sorted(set(ends_a) & set(ends_b)), 0, [], []
        for cut in cuts:
            left = [k for k, e in zip(a, ends_a) if start < e <= cut]
            right = [k for k, e in zip(b, ends_b) if start < e <= cut]
            groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            mine.append((left[-1], right[-1]))
            start = cut
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), mine))
    count = collections.Counter(p for *_, mine in rows for p in mine)
    highest = collections.defaultdict(int)
    for (_, second), n in count.items():
        highest[second] = max(highest[second], n)
    return [(a, b, g, len(m), sum(count[p] == highest[p[1]] for p in m), sum(count[p] for p in m), sha) for a, b, g, sha, m in rows]


def test_vocabulary_reads_like_its_own_library(both):
    rng = random.Random(2)
    texts = [random_text(rng, rng.randint(1, 60)) for _ in range(400)] + [" " * 5000, "a" * 5000, "\n \n" * 999]
    mine = token_alignment.byte_level()
    assert [list(x) for x in mine.ids(texts)] == [both[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert all(b"".join(mine.pieces[k] for k in ids) == (" " + t).encode() for t, ids in zip(texts, mine.ids(texts)))


def test_common_runs():
    rng = random.Random(4)
    for n in [1, 2, 3, 10, 50, 400] * 60:
        a, b = (sorted(rng.sample(range(n), rng.randint(0, n - 1))) + [n] for _ in range(2))
        if rng.random() < 0.3:
            b = a[:len(a) // 2] + [x for x in b if x > (a[len(a) // 2 - 1] if len(a) > 1 else -1)]
        runs = list(zip(*token_alignment.common_runs(a, b)))
        cut = [a[i + k] for i, j, length in runs for k in range(length)]
        assert cut == sorted(set(a) & set(b)) and all(a[i:i + length] == b[j:j + length] for i, j, length in runs)


@pytest.mark.parametrize("block", [1, 8 << 20])
def test_statistics_equal_brute_force(spark, tmp_path, both, block, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeighnorstu") for _ in range(rng.randint(1, 9))) for _ in range(50)]
    texts = [None, "", " ", "one", "<|endoftext|>", "twice", "twice", "long " * 9000] + [random_text(rng, rng.randint(1, 80)) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    data = [(None if k == 3 else k // 2, t, "own", 1.5) for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, links string, block double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_token_alignment(spark, str(tmp_path)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    wanted = [(row[0], *x) for row, x in zip(data, brute(texts, both))]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    groups = {r.id: r for r in token_alignment.token_groups(spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id int, text string")).collect()}
    assert groups[2].a == [] and len(groups[1].last_a) == len(groups[1].last_b) and groups[1].last_a[-1] == len(groups[1].a) - 1


def test_empty_table(spark):
    assert token_alignment.link_statistics(spark.createDataFrame([], "doc_id long, text string")).count() == 0
