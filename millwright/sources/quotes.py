"""Escape strings (``E'..'``) and dollar quotes of SQL dumps, rewritten as plain quoted text.

Which quote is open before a line depends on all lines before it. Each split reduces its lines to a map from the quote
open before them to the one open behind them, the maps of a file's splits are put together in their order, and each
split then rewrites its own lines. A task holds one batch of lines, or one short row for each split of a file.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is open, as it was opened; a dollar quote is its tag.
NOTHING, QUOTE, ESCAPE = "", "'", "E'"
_OPENS = re.compile(r"--|(?<!\w)[eE]'|'|(?<!\w)\$(?:[^\W\d]\w*)?\$")
_TAGS = re.compile(r"(?=(\$(?:[^\W\d]\w*)?\$))")
_BYTES = r"(?:\\(?:x[0-9a-fA-F]{1,2}|[0-7]{1,3}))+"
_IN_ESCAPE = re.compile(rf"''|'|{_BYTES}|\\(?:u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|.)?")
_BYTE = re.compile(r"\\x?([0-9a-fA-F]+)")
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_MAY_HOLD = r"(?<!\w)[eE]'|\$\w*\$"


def _unescaped(found: str) -> str:
    """What an escape stands for, a quote doubled. A backslash that ends its line stands for the line end itself."""
    if found in ("''", "\\"):
        return found.strip("\\")
    if re.fullmatch(_BYTES, found):
        values = bytes(int(m[1], 16 if m[0][1] == "x" else 8) & 255 for m in _BYTE.finditer(found))
        text = values.decode("utf-8", "replace")
    elif found[1] in "uU" and len(found) > 2:
        text = chr(int(found[2:], 16))
    else:
        text = _CONTROLS.get(found[1], found[1])
    return text.replace("'", "''")


def rewritten(line: str, is_open: str) -> tuple[str, str]:
    """(the line with plain quotes, what is open behind it), with ``is_open`` open before it."""
    out, at = [], 0
    while True:
        if is_open == NOTHING:
            found = _OPENS.search(line, at)
            if not found or found[0] == "--":
                return "".join([*out, line[at:]]), NOTHING
            out += [line[at:found.start()], "'"]
            is_open, at = found[0].upper() if found[0][-1] == "'" else found[0], found.end()
        elif is_open == ESCAPE:
            found = _IN_ESCAPE.search(line, at)
            if not found:
                return "".join([*out, line[at:]]), ESCAPE
            closes = found[0] == "'"
            out += [line[at:found.start()], "'" if closes else _unescaped(found[0])]
            is_open, at = NOTHING if closes else ESCAPE, found.end()
        else:
            end = line.find(is_open, at)
            inside = line[at:] if end < 0 else line[at:end]
            out.append(inside if is_open == QUOTE else inside.replace("'", "''"))
            if end < 0:
                return "".join(out), is_open
            out.append("'")
            is_open, at = NOTHING, end + len(is_open)


def _maps(lines: DataFrame) -> DataFrame:
    """(file, block, before, behind): what is open behind each split for what was open before it.

    A dollar quote whose tag a split does not hold stays open, so only tags that occur are in its map.
    """

    def run(batches):
        at, now = None, {}

        def done():
            before = [b for starts in now.values() for b in starts]
            behind = [state for state, starts in now.items() for _ in starts]
            columns = [[at[0]], [at[1]], [before], [behind]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        names = ["file", "block", "before", "behind"]
        types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            for line, *place in zip(*(batch.column(c).to_pylist() for c in ("line", "file", "block"))):
                if place != at:
                    if at:
                        yield done()
                    at, now, known = place, {s: [s] for s in (NOTHING, QUOTE, ESCAPE)}, set()
                for tag in set(_TAGS.findall(line)) - known if "$" in line else ():
                    known.add(tag)
                    now.setdefault(tag, []).append(tag)
                then: dict[str, list] = {}
                for state, starts in now.items():
                    then.setdefault(rewritten(line, state)[1], []).extend(starts)
                now = then
        if at:
            yield done()

    return lines.select("line", "file", "block").mapInArrow(run, "file string, block long, before array<string>, behind array<string>")


def _put_together(table: pa.Table) -> pa.Table:
    """(file, block, open) of the maps of one file: what is open before each of its splits."""
    rows = sorted(table.to_pylist(), key=lambda row: row["block"])
    is_open, result = NOTHING, []
    for row in rows:
        result.append(is_open)
        is_open = dict(zip(row["before"], row["behind"])).get(is_open, is_open)
    files, blocks = [row["file"] for row in rows], [row["block"] for row in rows]
    return pa.table({"file": pa.array(files, pa.string()), "block": pa.array(blocks, pa.int64()), "open": pa.array(result, pa.string())})


def with_plain_quotes(lines: DataFrame) -> DataFrame:
    """The placed lines with plain quotes only. Escapes that stand for line ends become line ends inside a line.

    Prefixes of other kinds (``B'..'``, ``X'..'``, ``U&'..'``) stay as they are. Comments (``--``) are left alone.
    """
    before = _maps(lines).groupBy("file").applyInArrow(_put_together, "file string, block long, open string")

    def run(batches):
        at, is_open = None, NOTHING
        for batch in batches:
            texts = []
            for line, start, *place in zip(*(batch.column(c).to_pylist() for c in ("line", "open", "file", "block"))):
                if place != at:
                    at, is_open = place, start
                text, is_open = rewritten(line, is_open)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *map(batch.column, ("file", "block", "pos"))], ["line", "file", "block", "pos"])

    # one short row a split; a broadcast leaves the lines in their order
    placed = lines.select("line", "file", "block", "pos").join(F.broadcast(before), ["file", "block"])
    return placed.mapInArrow(run, "line string, file string, block long, pos long")


def may_need_rewriting(lines: DataFrame) -> bool:
    """Whether a line holds what may open an escape string or a dollar quote; the search ends with the first."""
    return not lines.where(F.col("line").rlike(_MAY_HOLD)).isEmpty()
