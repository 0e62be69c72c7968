"""Words, language-model scores, quality rules and token counts against plain Python."""

from __future__ import annotations

import collections
import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millwright.llm import lm_score, quality, text, token_count

ODD = [
    (1, "The cat sat.\nThe cat sat.\n\n x "), (2, None), (3, ""), (4, " \t\n\x0b"), (5, "É à A\x1cB É"), (6, "word " * 3000),
    (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (None, "the cat ran"), (8, "#*$ a|b <c> & 100%"), (9, "x" * 5000),
    *((n, f"the cat number {n} sat on mat {n % 3}") for n in range(10, 60)),
]
SCHEMA = "doc_id long, text string, held_out string, kept int, token_counts double, quality_rules string"


def rows(spark, data=ODD):
    return spark.createDataFrame([(*r, "x", 1, 0.5, "y") for r in data], SCHEMA)


def plain_words(value, lower=True):
    raw = (value or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if lower else raw)


@pytest.mark.parametrize("lower", [True, False])
def test_words_of_slices(lower):
    values = [v for _, v in ODD] * 3
    array = pa.array(values).slice(5, 60)
    batch = pa.RecordBatch.from_arrays([array], ["text"])
    seen = 0
    for part in text.chunks([batch], limit=200):
        codes, starts, distinct = text.words(part.column("text"), lower)
        names = distinct.cast(pa.binary()).to_pylist()
        assert len(set(names)) == len(names)
        for k in range(part.num_rows):
            assert [names[c] for c in codes[starts[k]:starts[k + 1]]] == plain_words(values[5 + seen], lower)
            seen += 1
    assert seen == 60


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, order):
    found = lm_score.score(rows(spark), block_tokens=40, range_grams=50, order=order).collect()
    again = {(r.id, r.n_tokens, round(r.score, 6)) for r in lm_score.score(rows(spark), order=order).collect()}
    assert len(found) == len(ODD)
    assert {(r.id, r.n_tokens, round(r.score, 6)) for r in found} == again  # neither block nor range sizes matter
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter()
    for i, v in ODD:
        if not held(i):
            counts.update([*plain_words(v), None])
    n, types = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, v in ODD:
        tokens = [*plain_words(v), None]
        base = sum(math.log10((counts[t] + 1) / (n + types + 1)) for t in tokens)
        expected[i, held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)] += 1
    assert collections.Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)


class PlainModel:
    """Deleted interpolation over dictionaries of tuples, one token at a time."""

    def __init__(self, data, order):
        fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
        training = [(fold(i), plain_words(v)) for i, v in data if fold(i) != 2]
        self.order = order
        self.all = self.counted(words for _, words in training)
        kept = self.counted(words for f, words in training if f != 3)
        self.types = [g[0] for g in self.all if len(g) == 1 and g[0] != "begin"]
        evidence = collections.defaultdict(collections.Counter)
        for f, words in training:
            if f == 3:
                for bucket, *shares in self.looked_up(words, kept):
                    binned = tuple(2 ** (-round(-4 * math.log2(p)) / 4) if p else 0.0 for p in shares)
                    evidence[bucket][(*binned, 1 / (len(self.types) + 1))] += 1
        self.learned = {bucket: self.learn(seen) for bucket, seen in evidence.items()}
        together = sum(evidence.values(), collections.Counter())
        self.otherwise = self.learn(together) if together else (0.0, 0.0, 0.0, 1.0)

    @staticmethod
    def steps(words):
        """(token, the token before it, the two before it) of a text; the first has a beginning alone before it."""
        tokens = ["begin", *words, None]
        for k in range(1, len(tokens)):
            yield tokens[k], tokens[k - 1], tuple(tokens[max(0, k - 2):k])

    def counted(self, texts):
        counts = collections.Counter()
        for words in texts:
            counts["begin",] += 1
            for token, before, two in self.steps(words):
                counts.update([(token,), (before, token)])
                if self.order == 3:
                    counts["three", *two, token] += 1
        return counts

    def looked_up(self, words, counts):
        total = sum(n for g, n in counts.items() if len(g) == 1 and g != ("begin",))
        for token, before, two in self.steps(words):
            context, context_two = counts[before,], counts[two] if self.order == 3 else 0
            size = lambda c: min(math.ceil(math.log2(c + 1)), 39)
            yield (
                40 + size(context_two) if context_two else size(context), counts["three", *two, token] / context_two if context_two else 0.0,
                counts[before, token] / context if context else 0.0, counts[token,] / total if total else 0.0,
            )

    @staticmethod
    def learn(seen):
        weights = [0.25] * 4
        for _ in range(60):
            grown = [0.0] * 4
            for shares, n in seen.items():
                mixed = sum(w * p for w, p in zip(weights, shares))
                grown = [g + n * w * p / mixed for g, w, p in zip(grown, weights, shares)]
            weights = [g / sum(seen.values()) for g in grown]
        return weights

    def probabilities(self, words):
        for bucket, *shares in self.looked_up(words, self.all):
            three, two, one, uniform = self.learned.get(bucket, self.otherwise)
            weights = [three if bucket >= 40 else 0.0, two if bucket else 0.0, one, max(uniform, 1e-7)]
            yield sum(w * p for w, p in zip(weights, [*shares, 1 / (len(self.types) + 1)])) / sum(weights)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_by_dictionaries(spark, order):
    rng = np.random.default_rng(5)
    data = [*ODD, *((1000 + k, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 40)) for k in range(120))]
    model = PlainModel(data, order)
    expected = collections.Counter((i, round(sum(map(math.log10, model.probabilities(plain_words(v)))), 5)) for i, v in data)
    found = lm_score.score(rows(spark, data), block_tokens=300, range_grams=400, order=order)
    assert collections.Counter((r.id, round(r.score, 5)) for r in found.collect()) == expected
    assert len(model.learned) > 4  # several frequencies of contexts have weights of their own


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_probabilities(order):
    """The next-token probabilities of a context add up to one over all training tokens and the unknown one."""
    model = PlainModel(ODD, order)
    for before in [[], [b"the"], [b"the", b"cat"], [b"cat", b"the"], [b"unseen"], [b"unseen", b"sat"], [b"x" * 5000]]:
        nexts = [list(model.probabilities([*before, *([] if t is None else [t])]))[len(before)] for t in [*model.types, b"unknown"]]
        assert math.isclose(sum(nexts), 1, rel_tol=1e-9) and min(nexts) > 0


def test_mixture_weights():
    weights = lm_score.mixture_weights(
        pa.table({"bucket": [41, 41, 0], "three": [0, 4, -1], "two": [4, 4, -1], "one": [8, 8, 8], "n": [9, 1, 5]}), 100
    )
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == weights[0, 1] == 0


def test_scores_of_nothing(spark):
    assert lm_score.score(rows(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = lm_score.score(rows(spark, [(only, "a b")])).first()
    assert (alone.train_tokens, alone.n_known, alone.n_tokens) == (0, 0, 3) and alone.base_score == 0


def base_rules(value):
    words = re.findall(r"[^\x20\x09-\x0D]+", value or "")
    windows = collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    cover = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
    lines = [line for line in (value or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", value or "")), len(lines) - len(set(lines)), len(cover),
        len(words) < 10 or 100 * len(cover) > 20 * len(words),
    )


def test_quality_rules(spark):
    good = "plain words follow one another in this sentence number {} and it ends about here quite calmly."
    data = [*ODD, *((100 + k, good.format(k) if k % 3 else f"### BUY!! $$$ {k} *** %%% NOW!! ||| &&& CHEAP!! ### {k} $$$ *** !!!") for k in range(300))]
    docs = rows(spark, data)
    labels = spark.createDataFrame([(100 + k, int(k % 3 > 0), 0) for k in range(200)] + [(100, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = quality.apply_rules(docs, model)
    assert scored.columns == ["doc_id", "text", "held_out", "kept", "token_counts", "quality_rules"]
    found = scored.collect()
    assert len(found) == len(data)
    for r in found:
        q = r.quality_rules
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base_rules(r.text)
        assert q.kept == (not q.base_failed and q.probability >= quality.KEEP_FROM)
    unseen = [r for r in found if r.doc_id and r.doc_id >= 300]
    assert np.mean([(r.quality_rules.probability > 0.5) == ((r.doc_id - 100) % 3 > 0) for r in unseen]) > 0.97


def test_character_runs(monkeypatch):
    monkeypatch.setattr(quality, "_SPAN", 7)
    key = lambda run: functools.reduce(lambda x, c: (x << 20) ^ ord(c), run, 0)
    for text in ["", "a", "né", "日本語 and 🙂🙂 more, much more of the same"]:
        wanted = np.zeros(quality.BUCKETS, np.int64)
        for n in (1, 2, 3):
            for k in range(len(text) - n + 1):
                wanted[((((key(text[k:k + n]) << 2) + n - 1) * 0x9E3779B97F4A7C15) % (1 << 64)) >> (64 - quality.BUCKET_BITS)] += 1
        assert (quality.character_runs(text) == wanted).all()


def test_repeated_ids_stay_bounded(spark):
    docs = rows(spark, [(1, f"the same id again {k}") for k in range(500)] + [(2, "a text of its own")])
    training = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), train_rows=2)
    assert np.isfinite(training.weights).all()


def test_quality_without_labels(spark):
    docs, none = rows(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.quality_rules.probability > 0.99 for r in quality.apply_rules(docs, quality.fit(docs, none)).collect())
    one = spark.createDataFrame([(k, 0) for k in range(10, 40)], "doc_id long, quality int")
    assert all(r.quality_rules.probability < 0.1 for r in quality.apply_rules(docs, quality.fit(docs, one)).collect())
    assert quality.apply_rules(rows(spark, []), quality.fit(rows(spark, []), none)).count() == 0


PIECES = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -2.2, "▁ab": -3.1, "ba": -2.6, "bab": -4.0, "é": -3.0, "▁the": -1.0, "c": -2.0}


def segment(word):
    """The best segmentation by trying every one: (score, fewest tokens)."""
    byte = token_count.Trie(PIECES).byte_score
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * byte, -best[end - 1][1] - size)]
        options += [(best[k][0] + PIECES[word[k:end]], -best[k][1] - 1) for k in range(end) if word[k:end] in PIECES]
        score, tokens = max(options)
        best.append((score, -tokens))
    return best[-1][1]


def test_token_counts(spark):
    data = [*ODD, (70, "ab abab ba bab the thea é éa cab"), (71, "ab" * 400 + "ß")]
    found = token_count.token_counts(rows(spark, data), PIECES, trie_bytes=300)
    assert found.columns == ["doc_id", "text", "held_out", "kept", "quality_rules", "token_counts"]
    got = collections.Counter((r.doc_id, r.token_counts.n_words, r.token_counts.n_tokens) for r in found.collect())
    words = {i: [w.decode() for w in plain_words(v, lower=False)] for i, v in data}
    assert got == collections.Counter((i, len(words[i]), sum(segment("▁" + w) for w in words[i])) for i, _ in data)
    assert token_count.token_counts(rows(spark, []), PIECES).count() == 0


def test_public_vocabulary(spark):
    pieces = token_count.vocabulary()
    assert len(pieces) > 30_000 and pieces["▁the"] > pieces["▁vocabulary"] if "▁vocabulary" in pieces else True
    trie = token_count.Trie(pieces)
    words = sorted(["▁the", "▁there", "▁", "▁zzzzqqq", "▁the"])
    one_by_one = [token_count.Trie(pieces).counts([w])[0] for w in words]
    assert trie.counts(words) == one_by_one
