"""CSV records that run over lines, in files that are split anywhere; counts taken while gold is written."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from millwright.sources import csv_files, quotes, sql_dump

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "37")
    yield
    spark.conf.set(SPLIT, before)


def _text(rng):
    return "".join(rng.choice(['a', 'b"', '"', ',', '\n', ' ', '""', "x,y", "\n\n", '",\n"', "é"]) for _ in range(rng.randrange(9)))


def test_records_over_lines_and_splits_equal_python(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    for f in range(2):
        with open(tmp_path / f"part{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["a", "b", "c"])
            writer.writerows([f * 100 + i, _text(rng), rng.choice(["", "z", "p\nq"])] for i in range(60))
    expected = []
    for f in range(2):
        with open(tmp_path / f"part{f}.csv", newline="") as found:
            expected += list(csv.reader(found))[1:]
    read = csv_files.read_text_csv(spark, str(tmp_path), multiline=True)
    assert read.columns == ["a", "b", "c", "row_seq"]
    got = [[x["a"], x["b"] or "", x["c"] or ""] for x in read.orderBy("row_seq").collect()]
    assert got == expected


def test_records_equal_the_line_reader_where_there_are_no_breaks(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text('id,note\n1,5" pipe\n2,"a, ""b"""\n\n3,\n4,""\n5,say "hi"\n')
    one, other = (csv_files.read_text_csv(spark, str(tmp_path), multiline=m).orderBy("row_seq").drop("row_seq").collect() for m in (False, True))
    assert one == other and len(one) == 5 and one[0]["note"] == '5" pipe'


def test_header_only_and_wrong_number_of_fields(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("id,note\n")
    assert csv_files.read_text_csv(spark, str(tmp_path / "a.csv"), multiline=True).count() == 0
    (tmp_path / "b.csv").write_text('id,note\n1,"x\ny"\n2,"z",3\n')
    with pytest.raises(Exception, match="wrong number of fields"):
        csv_files.read_text_csv(spark, str(tmp_path / "b.csv"), multiline=True).collect()


def test_a_large_file_is_many_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f'{i},"line\n{i}"\n' for i in range(50)))
    read = csv_files.read_text_csv(spark, str(tmp_path / "a.csv"), multiline=True)
    assert read.select(F.countDistinct("row_seq.block")).head()[0] > 5 and read.count() == 50


def _gold(spark, rows):
    from millwright.schemas import GOLD_LABELS

    names = ["machine_id_std", "window_start", "window_end", "split_set", GOLD_LABELS[0], "x"]
    types = ["string", "timestamp_ntz", "timestamp_ntz", "string", "boolean", "double"]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def test_counts_of_the_write_equal_counts_of_the_table(spark, tmp_path):
    from datetime import datetime

    from millwright.operators import contracts as ct
    from millwright.sinks.tables import write_gold

    at = [datetime(2031, 1, 1, h) for h in range(9)]
    good = [(f"M{h % 2}", at[h], at[h], ("train", "validation", "test")[h % 3 if h < 7 else 0], h % 2 == 0, None if h == 3 else 1.0) for h in range(8)]
    for i, rows in enumerate([good, [], good + good[:2], [*good, (None, at[8], at[8], "train", None, None)], [*good, ("M5", at[8], at[8], "later", None, 1.0)]]):
        counted, seen = ct.observe_gold(_gold(spark, rows).repartition(3))
        stored = spark.read.parquet(write_gold(counted, str(tmp_path), version=str(i))).select(*counted.columns) if rows else counted
        if not rows:
            counted.write.parquet(str(tmp_path / "empty"))
        expected = ct.gold_checks(stored).head().asDict()
        found = seen.get | ct.key_copies(stored).head().asDict()
        assert {k: found[k] for k in expected if k != "columns"} == {k: v for k, v in expected.items() if k != "columns"}
        if i == 0:
            checked = ct.validate_written(seen, stored)
            assert checked["warnings"] == ["only 6 columns"]
            one = ct.written_metrics(spark, checked).head()
            assert one == ct.gold_metrics(stored).select(*one.__fields__).head()
        if i in (2, 3):
            with pytest.raises(ct.ContractError):
                ct.validate_written(seen, stored)
    assert found["split:other"] == 1


def test_long_values_of_a_dump(spark, tmp_path):
    value = "it's (a) -- note; on conflict, " * 3000
    doubled = value.replace("'", "''")
    (tmp_path / "long.sql").write_text(f"INSERT INTO t (a, b) VALUES\n(1, '{doubled}'),\n(2, NULL); -- {'x' * 9000}\n")
    rows = sql_dump.insert_rows(sql_dump.dump_lines(spark, str(tmp_path / "long.sql")), "t", ["a", "b"])
    assert {tuple(r) for r in rows.collect()} == {("1", value), ("2", None)}


def _quoted(rng, value):
    """A value as a plain, an escape or a dollar quoted literal."""
    kind = rng.randrange(3)
    if kind == 0:
        return "'" + value.replace("'", "''") + "'"
    if kind == 1:
        tag = rng.choice([t for t in ("$$", "$q$", "$Tag_1$") if t not in value and not (value + t).startswith(t[1:]) and t not in value + t[:-1]])
        return tag + value + tag
    ways = {"'": ["\\'", "''", "\\x27", "\\047"], "\n": ["\\n", "\n", "\\\n"], "\\": ["\\\\"], "é": ["é", "\\u00e9", "\\xC3\\xa9"], "\t": ["\\t"]}
    return rng.choice("eE") + "'" + "".join(rng.choice(ways.get(c, [c])) for c in value) + "'"


@pytest.mark.parametrize("block", [211, 1 << 20])
def test_escape_strings_and_dollar_quotes(spark, tmp_path, block):
    rng = random.Random(block)
    parts = ["a", "'", "\n", "\\", "é", "(", ")", ",", " -- ", ";", "\t", "e", " $q", "x$y ", "E"]
    expected, before = [], spark.conf.get(SPLIT)
    for f in range(2):
        tuples = []
        for i in range(40):
            value = "".join(rng.choice(parts) for _ in range(rng.randrange(9))) + "."
            expected.append((str(f * 100 + i), value))
            tuples.append(f"({f * 100 + i}, {_quoted(rng, value)})" + rng.choice(["", "", " -- it's E'open or $q$ open"]))
        body = "".join(f"{t.split(' -- it')[0]}{',' if k < 39 else ';'}{t[len(t.split(' -- it')[0]):]}\n" for k, t in enumerate(tuples))
        (tmp_path / f"part{f}.sql").write_text("INSERT INTO t (a, b) VALUES\n" + body)
    spark.conf.set(SPLIT, str(block))
    try:
        rows = sql_dump.insert_rows(sql_dump.dump_lines(spark, str(tmp_path)), "t", ["a", "b"]).collect()
    finally:
        spark.conf.set(SPLIT, before)
    assert sorted(tuple(r) for r in rows) == sorted(expected)


def test_quotes_of_one_line():
    assert quotes.rewritten(r"x E'a\'b\101' y", "") == ("x 'a''bA' y", "")
    assert quotes.rewritten("$a$it's$$ $a$, name'E'", "") == ("'it''s$$ ', name'E'", "")
    assert quotes.rewritten("b$q$ -- $$", "$q$") == ("b' -- $$", "")
    assert quotes.rewritten("tail\\", "E'") == ("tail", "E'")
    assert quotes.rewritten("no end", "'") == ("no end", "'") and quotes.rewritten("", "$x$") == ("", "$x$")
