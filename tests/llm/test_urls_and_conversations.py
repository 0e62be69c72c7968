"""URL verdicts and repaired conversations against plain Python and DuckDB."""

from __future__ import annotations

import hashlib
import itertools
import random

import duckdb
import pytest

from millwright.llm import conversation_repair, queries, url_filter

ARTICLE = "<article><p>text</p></article>"


def canonical(target):
    return f'<html><head><LINK title="x" rel="canonical" href="{target}"></head>{ARTICLE}</html>'


PAGES = [
    (1, "https://a.example.net/en/1", ARTICLE), (2, "http://a.EXAMPLE.net/de/1?q=1#top", ARTICLE), (3, "https://x.org/fr/2", ARTICLE),
    (4, "https://example.com/de/", ARTICLE), (5, "https://notexample.com/de/3", ARTICLE), (6, None, ARTICLE), (7, "no address", None), (8, "", ""),
    (9, "https://net", ARTICLE), (10, "https://one.info/a", canonical("https://two.info/b?utm_source=x&k=1")),
    (11, "https://two.info/b?k=1#part", '<meta content="0; URL=\'http://bad.net/spam\'" http-equiv="refresh">'),
    (12, "https://three.info/c", canonical("/d")), (13, "https://three.info/d", canonical("https://example.org/fr/ok")),
    (14, "https://four.info/x/y", canonical("z?a=1&amp;b=2")), (15, "https://four.info/x/z?a=1&b=2", canonical("//sub.example.com/de/w")),
    (16, "https://org/fr/in", canonical("https://two.info/b?k=1")), (17, "https://five.info/", f"<!-- {canonical('http://bad.net/')} -->{ARTICLE}"),
    (18, "https://six.info/", f"<script>'{canonical('http://bad.net/')}'</script>{ARTICLE}"), (1, "https://a.example.net/en/1", ARTICLE),
    (19, "https://seven.info/p", canonical("#top")), (20, "https://two.info/b?k=1", None), (21, "https://eight.info", canonical("?x=1")), (22, "https://eight.info/?x=1", canonical("http://bad.net/q")),
]
BLOCKED = {2: "rule", 4: "rule", 10: "alias", 11: "alias", 14: "alias", 15: "alias", 20: "alias", 21: "alias", 22: "alias"}


def test_url_verdicts(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    found = [tuple(r) for r in queries.op11_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "by").collect()]
    by_id = {r[0]: r for r in found}
    assert len(found) == len(PAGES) and {k for k, r in by_id.items() if r[4] == "block"} == set(BLOCKED)
    assert all(by_id[k][5] == by for k, by in BLOCKED.items())
    assert by_id[1][3:] == ("example.net/en/", "allow", "rule") and by_id[16][3:] == ("org/fr/", "allow", "rule")
    assert by_id[2][1:4] == ("a.example.net", "/de/1", "net/") and by_id[9][1:4] == ("net", "", None) and by_id[6][1:3] == ("", "")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = connection.execute(f"SELECT page_id, host, path, rule, verdict, \"by\" FROM ({url_filter.ORACLE})").fetchall()
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_urls_keep_columns_and_take_redirects(spark):
    schema = "page_id long, url string, html string, host string, node int, url_filter int, row string, alias int"
    frame = spark.createDataFrame([(1, "http://a.info/", None, "own", 5, 6, "r", 7)], schema)
    moved = spark.createDataFrame([("http://a.info/#x", "http://b.info/"), ("http://b.info/", "http://c.net/"), (None, "http://d.net/")], "source string, target string")
    row = url_filter.judge(frame, redirects=moved).first()
    assert (row.host, row.node, row.row, row.alias) == ("own", 5, "r", 7) and row.url_filter.verdict == "block" and row.url_filter.by == "alias"
    assert url_filter.judge(frame.limit(0)).count() == 0


def plain_viterbi(turns):
    """(cost, audit, lines) with whole strings and without pruning."""
    follow = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def filled(ways):
        out, layer = list(ways), list(ways)
        for _ in range(3):
            layer = [(follow[s][0], c + 5, a + "I", [*t, follow[s][1] + ":"]) for s, c, a, t in layer]
            out += layer
        return out

    seen, ways = set(), [(0, 0, "", [])]
    for role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        gone = not end or (role, text) in seen
        more = 0 if end in ".!?" else 5
        seen.add((role, text))
        new = []
        for s, c, a, t in filled(ways):
            new.append((s, c + 2, a + "D", t))
            if not gone:
                to, other = follow[s]
                new.append((to, c + 1 + more, a + "R", [*t, f"{other}:{text}"]))
                if s == 0 and role[:1] == "s":
                    new.append((1, c + more, a + "K", [*t, f"{role}:{text}"]))
                if role[:1] == other[0]:
                    new.append((to, c + more, a + "K", [*t, f"{role}:{text}"]))
        best = {}
        for way in new:
            if way[0] not in best or way[1:3] < best[way[0]][1:3]:
                best[way[0]] = way
        ways = list(best.values())
    return min(((c, a, t) for s, c, a, t in filled(ways) if s in (0, 3)), key=lambda w: w[:2])


def every_repair(turns):
    """The best of all edit strings with up to two inserts before each turn, by trying them."""
    found = []
    faults = [conversation_repair.fault_of(t, (r, t) in turns[:k]) for k, (r, t) in enumerate(turns)]
    for edits in itertools.product("DKR", repeat=len(turns)):
        for holes in itertools.product(range(3), repeat=len(turns) + 1):
            state, cost, letters = 0, 0, ""
            for k, hole in enumerate(holes):
                for _ in range(hole):
                    state, cost, letters = conversation_repair.FOLLOWING[state][0], cost + 5, letters + "I"
                if k == len(turns):
                    break
                letters += edits[k]
                if edits[k] == "D":
                    cost += 2
                elif faults[k] in ("blank", "duplicate"):
                    state = None
                elif edits[k] == "R":
                    state, cost = conversation_repair.FOLLOWING[state][0], cost + 1
                else:
                    state = conversation_repair.KEPT.get((state, turns[k][0][:1]))
                if state is None:
                    break
                cost += 5 if faults[k] == "truncated" and edits[k] != "D" else 0
            if state in (0, 3):
                found.append((cost, letters))
    return min(found)


def streamed(turns):
    repair, seen, out, most = conversation_repair.Repair(), set(), [], 0
    for role, text in turns:
        fault = conversation_repair.fault_of(text, (role, text) in seen)
        seen.add((role, text))
        out += repair.add((0, role, text, fault), role, fault)
        most = max(most, len(out))
    final = len(out)
    return out + list(repair.end()), final


def random_turns(rng, n):
    roles = ["user", "assistant", "system", "", " ", "User", "usher", "tool"]
    texts = ["Well.", "Fine!", "cut off", "", " \n", "So? ", "Yes.", "end .", "x" * 50, "naïve…"]
    return [(rng.choices(roles, [8, 8, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.random()}.") for _ in range(n)]


def test_repair_is_the_cheapest_and_least():
    rng = random.Random(5)
    for n in [*range(5)] * 8:
        turns = random_turns(rng, n)
        edits, _ = streamed(turns)
        assert every_repair(turns)[1] == "".join(e[0] for e in edits) == plain_viterbi(turns)[1], turns
    for n in [5, 9, 17, 40, 90] * 12:
        turns = random_turns(rng, n)
        assert "".join(e[0] for e in streamed(turns)[0]) == plain_viterbi(turns)[1], turns


def test_edits_leave_before_the_end():
    turns = [("user", f"Question {k}?") if k % 2 == 0 else ("assistant", f"Answer {k}.") for k in range(3000)]
    turns[1500:1500] = [("user", "user cut"), ("system", "Odd.")]
    edits, before_end = streamed(turns)
    assert before_end > 2990 and sum(e[0] != "K" for e in edits) == 2
    crowd = [("user", f"Only users {k}.") for k in range(3000)]  # undecided to the end: the first turn's fate hangs on parity
    assert "".join(e[0] for e in streamed(crowd)[0]) == "KR" * 1500


def test_conversations_equal_plain_python_and_sql(spark, tmp_path):
    rng = random.Random(8)
    data = []
    for conv in range(60):
        turn = rng.randrange(3)
        for role, text in random_turns(rng, rng.choice([1, 2, 5, 8, 30])):
            data.append((conv, turn if rng.random() < 0.95 else None, role if rng.random() < 0.95 else None, text if rng.random() < 0.95 else None))
            turn += rng.choice([0, 1, 1, 1, 2])
    data += [(None, 1, "user", "lost."), (None, None, None, None), (900, 1, "user", "Long " * 9000 + ".")] + [(901, 4, "user", "Same.")] * 40
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op13_conversation_repair(spark, str(tmp_path))
    names = sorted(found.columns)
    rows = sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ", ".join(names)
    assert rows == sorted(connection.execute(f"SELECT {columns} FROM ({conversation_repair.ORACLE})").fetchall(), key=repr)
    damaged = conversation_repair.damage(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()
    by_conv = {r.conv_id: r for r in found.collect()}
    assert set(by_conv) == {r[0] for r in data}
    for conv, row in by_conv.items():
        turns = sorted((r for r in damaged if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0, r.role, r.text))
        cost, audit, lines = plain_viterbi([(r.role, r.text) for r in turns])
        assert (row.cost, row.audit, row.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("empty", [True, False])
def test_repair_has_texts_and_takes_odd_tables(spark, empty):
    schema = "conv_id string, turn int, role string, text string, mark string, place int, first string"
    data = [] if empty else [("c", 0, "user", "Hi.", "m", 1, "f"), ("c", 1, "user", "Hello", "m", 1, "f"), ("c", 1, "user", "Hello", "n", 2, "f"), (None, None, None, None, None, None, None)]
    edits = conversation_repair.repair(spark.createDataFrame(data, schema))
    got = [(r.conv, r.place, r.edit, r.old_role, r.role, r.text, r.fault) for r in edits.collect()]
    wanted = [] if empty else [
        (None, 0, "Delete", "", None, "", "blank"), ("c", 0, "Delete", "user", None, "Hi.", None),
        ("c", 1, "Delete", "user", None, "Hello", "truncated"), ("c", 2, "Delete", "user", None, "Hello", "duplicate"),
    ]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert conversation_repair.audits(edits).count() == len({r[0] for r in wanted})
