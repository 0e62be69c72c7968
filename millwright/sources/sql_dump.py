"""INSERT blocks of SQL dump text as rows.

Dump files are read line by line, so a large file is split over tasks like any text file. Which INSERT
a tuple line belongs to depends on the lines before it: inside a file block that is a window, across
blocks the last open statement is carried over. So are open quotes and brackets: lines are joined until both are
closed, wherever a tuple is broken. Comments (``--`` outside quotes) take no part in that. Escape strings and dollar
quotes are rewritten as plain quoted text first, if the dump holds any (``sources/quotes.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.columns import to_whole
from millwright.operators.clean import prepare_maintenance
from millwright.operators.contracts import ContractError
from millwright.schemas import MACHINE_COLUMNS, MAINTENANCE_COLUMNS
from millwright.sources.lines import before_line, carried, earlier_blocks, joined, placed_lines, with_open_quotes
from millwright.sources.quotes import may_need_rewriting, with_plain_quotes

# Fixed patterns of the dump format; quoted text may hold any character, a quote in it is doubled. Repeated groups are
# possessive: they match in a loop, so that a value of any length needs no more stack than a short one.
QUOTED = r"'[^']*+(?:''[^']*+)*+'"
CONFLICT = r"\bON\s+CONFLICT\b"
OPENS = r"(?i)^\s*INSERT\s+INTO\s+(?:\w+\.)?\"?(\w+)\"?\s*\([^)]*\)(?:\s*VALUES)?"
TUPLE = rf"\(\s*+((?:{QUOTED}|[^'()]++)*+)\)"
FIELD = rf"({QUOTED}|[^,'\s][^,']*)"
BEFORE_CONFLICT = rf"(?i)^((?:{QUOTED}|[^'o]++|(?!{CONFLICT})o)*+){CONFLICT}"
BETWEEN = r"(?is)^[\s,;]*(?:VALUES)?[\s,;]*(?:--.*)?$"
CLOSES = rf"(?i)^(?:{QUOTED}|[^'o;]++|(?!{CONFLICT}|;\s*$)[o;])*+(?:{CONFLICT}|;\s*$)"


def dump_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The placed lines of dump files, all quoted text in plain quotes."""
    lines = placed_lines(spark, path)
    return with_plain_quotes(lines) if may_need_rewriting(lines) else lines


def _after(text: Column) -> tuple[Column, Column]:
    """(is a quote open behind the text, brackets opened less closed) when none is open before it.

    Quoted parts and a comment behind the last of them are cut out from left to right, so a quote in a comment and two
    dashes in a quote are what they look like; what is left of a quote that does not close is the text's own end.
    """
    plain = F.regexp_replace(text, r"'[^']*'|--.*$", "")
    outside = F.regexp_replace(plain, "(?s)'.*$", "")
    return plain.contains("'"), F.length(F.replace(outside, F.lit(")"))) - F.length(F.replace(outside, F.lit("(")))


def with_quote_state(lines: DataFrame) -> DataFrame:
    """``lines`` with ``__inside`` (a quote is open before the line) and ``__opened`` (brackets, net, outside quotes)."""
    line = F.col("line")
    from_plain, opened_plain = _after(line)
    from_quote, opened_quote = _after(F.regexp_extract(line, r"(?s)^[^']*'(.*)$", 1))
    stays = ~line.contains("'")
    rows = with_open_quotes(lines, from_plain, stays | from_quote)
    opened = F.when(F.col("__inside"), F.when(stays, 0).otherwise(opened_quote)).otherwise(opened_plain)
    return rows.withColumn("__opened", opened)


def joined_lines(lines: DataFrame) -> DataFrame:
    """Lines joined while a quote or a bracket is open, at the place of their first line; comments are blanked."""
    inside = F.col("__inside")
    rows = carried(with_quote_state(lines), F.col("__opened"), "__depth")
    head = F.when(inside, F.regexp_extract("line", r"^([^']*'?)", 1)).otherwise("")
    tail = F.when(inside, F.regexp_replace("line", r"^[^']*'?", "")).otherwise(F.col("line"))
    kept = F.regexp_replace(tail, r"^((?:'[^']*+'|[^'-]++|-(?!-))*+)--.*$", "$1")
    return joined(rows.withColumn("line", F.concat(head, kept)), ~inside & (F.col("__depth") == 0))


def _literal(token: Column) -> Column:
    text = F.regexp_replace(token, r"^\s+|\s+$", "")
    unquoted = F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), "''", "'")
    return F.when(text.startswith("'"), unquoted).when(F.upper(text) != "NULL", text)


def insert_rows(lines: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """The tuples inserted into ``table`` as text columns named by position; SQL NULL becomes null."""
    lines = joined_lines(lines)
    opened = F.regexp_extract("line", OPENS, 1)
    marked = lines.withColumns(
        {
            "__open": F.when(opened != "", F.lower(opened)),
            "__after": F.when(F.col("line").rlike(CLOSES), "").when(opened != "", F.lower(opened)),
        }
    )
    last = marked.filter(F.col("__after").isNotNull()).groupBy("file", "block").agg(F.max_by("__after", "pos").alias("__last"))
    blocks = marked.select("file", "block").distinct().join(last, ["file", "block"], "left")
    held = blocks.select("file", "block", F.last("__last", ignorenulls=True).over(earlier_blocks()).alias("__carried"))
    placed = marked.join(held, ["file", "block"]).withColumn(
        "__table", F.coalesce("__open", F.last("__after", ignorenulls=True).over(before_line()), "__carried")
    )
    mine = placed.filter(F.col("__table") == table.lower())

    body = F.regexp_replace("line", OPENS, "")
    cut = F.regexp_extract(body, BEFORE_CONFLICT, 1)
    body = F.when(body.rlike(BEFORE_CONFLICT), cut).otherwise(body)
    rest = F.regexp_replace(body, TUPLE, "")
    strange = F.raise_error(F.concat(F.lit(f"{table}: no tuple in a dump line: "), F.substring(F.trim(rest), 1, 200))).cast("string")
    whole = F.when(rest.rlike(BETWEEN), body).otherwise(strange)
    tuples = mine.select(F.explode(F.regexp_extract_all(whole, F.lit(TUPLE), F.lit(1))).alias("tuple"))
    fields = tuples.select(F.transform(F.regexp_extract_all("tuple", F.lit(FIELD), F.lit(1)), _literal).alias("f"))
    wrong = F.raise_error(F.concat(F.lit(f"{table}: expected {len(columns)} values, found "), F.size("f").cast("string")))
    checked = fields.withColumn("f", F.when(F.size("f") == len(columns), F.col("f")).otherwise(wrong.cast("array<string>")))
    return checked.select(*[F.col("f")[i].alias(c) for i, c in enumerate(columns)])


def typed_machines(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "commissioning_date": F.col("commissioning_date").try_cast("date"),
            "max_daily_capacity": to_whole(F.col("max_daily_capacity")),
            "max_hourly_capacity_pieces": to_whole(F.col("max_hourly_capacity_pieces")),
        }
    )


def typed_maintenance(rows: DataFrame) -> DataFrame:
    return prepare_maintenance(rows.withColumn("maintenance_id", to_whole(F.col("maintenance_id"))))


def load_machine_reference(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Machines and maintenances; raises when the dump has no block for one of them."""
    lines = dump_lines(spark, path)
    machines = typed_machines(insert_rows(lines, "machine", MACHINE_COLUMNS))
    maintenance = typed_maintenance(insert_rows(lines, "maintenance", MAINTENANCE_COLUMNS))
    for name, frame in (("machine", machines), ("maintenance", maintenance)):
        if frame.isEmpty():
            raise ContractError(f"the dump has no INSERT block for table {name!r}")
    return machines, maintenance
