"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct words.

The text's distinct words form a trie; the best segmentation score and its number of tokens are computed once for each
trie node, so words share the work of their common beginnings, and each word's end node holds its count. The trie is
walked over the sorted words: only the path to the present word is in memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millwright.llm.text import chunks, words

#: A word begins with this character in the vocabulary.
WORD_START = "▁"
#: Log scores of pieces follow their rank in the vocabulary (the vocabulary files hold no probabilities).
#: A character without a piece is spelt in bytes, each scored like this much lower a rank than the last piece.
BYTE_RANKS = 10.0
#: Bytes of text whose distinct words share a trie.
TRIE_BYTES = 16 << 20

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and log scores of a sentencepiece file: ordinary pieces in rank order, by the law of rank and frequency."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(k) for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]
    return {p: -math.log(rank + 2) for rank, p in enumerate(pieces)}


class Trie:
    """The forward scores along the path to the present word."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.byte_score = -math.log(BYTE_RANKS * (len(pieces) + 2))
        # a piece that ends with a character has one of these lengths
        endings: dict[str, set[int]] = {}
        for p in pieces:
            endings.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in endings.items()}

    def counts(self, ordered: list[str]) -> list[int]:
        """Tokens of each word of a sorted list; ties of score go to fewer tokens."""
        pieces, lengths, byte_score = self.pieces, self.lengths, self.byte_score
        score, tokens, before, found = [0.0], [0], "", []
        for word in ordered:
            shared, limit = 0, min(len(before), len(word))
            if before[:limit] == word[:limit]:
                shared = limit
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del score[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                last = word[end - 1]
                size = len(last.encode("utf-8", "surrogatepass"))
                best, count = score[end - 1] + size * byte_score, tokens[end - 1] + size
                for n in lengths.get(last, ()):
                    if n > end:
                        break
                    gain = pieces.get(word[end - n:end])
                    if gain is not None:
                        total = score[end - n] + gain
                        if total > best or total == best and tokens[end - n] + 1 < count:
                            best, count = total, tokens[end - n] + 1
                score.append(best)
                tokens.append(count)
            found.append(tokens[len(word)])
            before = word
        return found


def token_counts(docs: DataFrame, pieces: dict[str, float], text_col: str = "text", out: str = "token_counts",
                 trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``out`` (n_words, n_tokens).

    A text's tokens are those of its words, each led by ``WORD_START``. Null and blank texts have none. Words of any
    length are segmented whole. A column already named ``out`` is replaced; repeated rows are counted each; an empty
    table stays empty. No row leaves its task: the words of about ``trie_bytes`` of text share a trie.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    struct = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        trie = Trie(shared.value)
        for batch in chunks(batches, text_col, trie_bytes):
            codes, starts, distinct = words(batch.column(text_col), lower=False)
            led = [WORD_START + w for w in distinct.to_pylist()]
            order = sorted(range(len(led)), key=led.__getitem__)
            counts = np.zeros(len(led), np.int64)
            counts[order] = trie.counts([led[k] for k in order])
            total = np.concatenate(([0], np.cumsum(counts[codes])))
            n_tokens = total[starts[1:]] - total[starts[:-1]]
            result = pa.StructArray.from_arrays([pa.array(np.diff(starts)), pa.array(n_tokens)], names=["n_words", "n_tokens"])
            yield pa.RecordBatch.from_arrays([*batch.columns, result], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, struct)]))

