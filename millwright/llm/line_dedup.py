"""Line deduplication by a tree of log templates.

A line's place in the tree is its number of words and its first ``DEPTH`` words; words with a digit count as one
variable word. Under a leaf, a word stays where enough documents have it at that position and is a variable field
elsewhere; lines that agree in what stays share a template. A template with enough constant words that recurs in
``MIN_DOCS`` documents or more is boilerplate: its lines go, but for those of the first document that has them.

Nothing is compared in pairs and no leaf is gathered: the words of a leaf are counted by position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.storage import materialize
from millwright.llm.text import chunks, hashes, mix, words

DEPTH = 3
MIN_DOCS = 3
#: Least share of constant words in a template.
CONSTANT = 0.7
_VARIABLE = np.uint64(0x5EED000000FA51AB)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _parsed(texts: pa.Array):
    """Lines of a slice: (text of each line, its number in the text, first word of each line and end, word hashes)."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    lines = lists.flatten()
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    codes, starts, distinct = words(lines, lower=False)
    hashed = mix(hashes(distinct))
    hashed[pc.match_substring_regex(distinct, "[0-9]").to_numpy(zero_copy_only=False)] = _VARIABLE
    return owner, number, starts, hashed[codes]


def _sums(values, starts):
    total = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    return total[starts[1:]] - total[starts[:-1]]


def _located(docs: DataFrame, id_type: str) -> DataFrame:
    """(id, mark, line, n, leaf, form): every line with a word, its leaf and the hash of its words."""

    def run(batches):
        for batch in chunks(batches):
            owner, number, starts, hashed = _parsed(batch.column("text"))
            n = np.diff(starts)
            place = np.arange(len(hashed)) - np.repeat(starts[:-1], n)
            placed = mix(hashed + place.astype(np.uint64) * _PLACE)
            form = mix(_sums(placed, starts) + n.astype(np.uint64))
            leaf = mix(_sums(np.where(place < DEPTH, placed, np.uint64(0)), starts) + n.astype(np.uint64))
            keep = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(owner[keep])), batch.column("mark").take(pa.array(owner[keep])),
                pa.array(number[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)),
                pa.array(leaf[keep].view(np.int64)), pa.array(form[keep].view(np.int64)),
            ], ["id", "mark", "line", "n", "leaf", "form"])

    return docs.mapInArrow(run, f"id {id_type}, mark long, line int, n int, leaf long, form long")


def _words_of(docs: DataFrame) -> DataFrame:
    """(leaf, form, docs, words) of rows that name lines of their text: ``wanted`` has (line, leaf, form, docs)."""

    def run(batches):
        for batch in chunks(batches):
            owner, number, starts, hashed = _parsed(batch.column("text"))
            first = np.searchsorted(owner, np.arange(batch.num_rows))
            leaf, form, docs, found = [], [], [], []
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    at = first[k] + w["line"]
                    leaf.append(w["leaf"])
                    form.append(w["form"])
                    docs.append(w["docs"])
                    found.append(hashed[starts[at]:starts[at + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), pa.array(form, pa.int64()), pa.array(docs, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["leaf", "form", "docs", "words"],
            )

    return docs.mapInArrow(run, "leaf long, form long, docs long, words array<long>")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                    constant: float = CONSTANT) -> DataFrame:
    """(id, mark, line): lines to drop, by id, text hash and line number."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    lines = materialize(_located(rows, id_type), "lines")
    key = F.struct("id", "mark")
    leaves = (
        lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.min(key).alias("low"), F.max(key).alias("high"))
        .where((F.col("lines") >= min_docs) & (F.col("low") != F.col("high"))).select("leaf")
    )
    shared = materialize(lines.join(leaves, "leaf", "left_semi"), "shared-lines")

    # each form's words, from the first document that has it
    forms = shared.groupBy("leaf", "form", "id", "mark").agg(F.min("line").alias("line")).groupBy("leaf", "form").agg(
        F.count("*").alias("docs"), F.min(F.struct("id", "mark", "line")).alias("at")
    )
    wanted = forms.groupBy(F.col("at.id").alias("w_id"), F.col("at.mark").alias("w_mark")).agg(
        F.collect_list(F.struct(F.col("at.line").alias("line"), "leaf", "form", "docs")).alias("wanted")
    )
    once = rows.join(wanted, rows["id"].eqNullSafe(wanted["w_id"]) & (rows["mark"] == wanted["w_mark"])).select("text", "wanted")
    spelt = materialize(_words_of(once).dropDuplicates(["leaf", "form"]), "forms")

    each = spelt.select("leaf", "form", "docs", F.posexplode("words").alias("place", "word"))
    # what is joined to a hot leaf or line is written first, so that Spark can split the join's large partitions
    stays = materialize(each.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("have")).where(F.col("have") >= min_docs), "staying-words")
    kept = each.join(stays, ["leaf", "place", "word"], "left_semi").groupBy("leaf", "form").agg(
        F.count("*").alias("constant"), F.bit_xor(F.xxhash64("place", "word")).alias("template")
    )
    of_line = shared.join(materialize(kept, "templates"), ["leaf", "form"]).where(F.col("constant") >= F.lit(constant) * F.col("n"))
    by_doc = of_line.groupBy("leaf", "template", "id", "mark").agg(F.collect_list("line").alias("lines"))
    by_doc = materialize(by_doc, "template-lines")
    recurring = by_doc.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min(key).alias("first")).where(F.col("docs") >= min_docs)
    recurring = materialize(recurring, "recurring")
    drop = by_doc.join(recurring.select("leaf", "template", "first"), ["leaf", "template"]).where(~key.eqNullSafe(F.col("first")))
    return drop.select("id", "mark", F.explode("lines").alias("line"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                         constant: float = CONSTANT, out: str = "dropped_lines") -> DataFrame:
    """All rows and columns of ``docs``, the text without its recurring lines, and their number in ``out``.

    A document is an id with a text: rows that agree in both are one and lose the same lines. Its lines stay if it is
    the first (by id, then text hash) with their template. Lines without a word, and line ends, stay as they are.
    Null and empty texts are unchanged; a null id is an id like any other and comes first. A column already named
    ``out`` is replaced, all others are kept whatever their names; an empty table stays empty.
    """
    docs = docs.drop(out)
    gone, of, mark = (unused(n, docs.columns) for n in ("gone", "of", "mark"))
    drops = recurring_lines(docs, id_col, text_col, min_docs, constant)
    by_row = drops.groupBy(F.col("id").alias(of), F.col("mark").alias(mark)).agg(F.collect_set("line").alias(gone))
    mine = docs[id_col].eqNullSafe(by_row[of]) & (F.xxhash64(docs[text_col]) == by_row[mark])
    joined = docs.join(by_row, mine, "left").select(*(docs[c] for c in docs.columns), gone)
    names, fields = docs.columns, docs.schema.fields

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(text_col), batch.column(gone)
            dropped = pc.fill_null(pc.list_value_length(lists), 0)
            at = np.flatnonzero(dropped.to_numpy(zero_copy_only=False))
            if len(at):
                new = [without(t.as_py(), set(x.values.to_pylist())) for t, x in zip(texts.take(pa.array(at)), lists.take(pa.array(at)))]
                hit = np.zeros(len(texts), bool)
                hit[at] = True
                texts = pc.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type))
            columns = [texts if n == text_col else c for n, c in zip(batch.schema.names, batch.columns) if n != gone]
            yield pa.RecordBatch.from_arrays([*columns, dropped.cast(pa.int64())], [*names, out])

    return joined.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))


def without(text: str, gone: set[int]) -> str:
    """The text without the lines of these numbers."""
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def unused(name: str, columns) -> str:
    """The name, with as many underlines behind it as make it none of ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
