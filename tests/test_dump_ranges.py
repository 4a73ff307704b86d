"""Dumps read in many byte ranges, against a plain reader of characters; what is left out of them; values of all kinds."""

import random

import pytest
from pyspark.sql import functions as F

from cohortmart.functions.literals import literal_text
from cohortmart.sources import dump, statements
from tests.conftest import rows


def plain_statements(text):
    """Statements without comments, character by character; with whether a semicolon ended them, and where they begin."""
    out, now, begin, i, quote = [], [], None, 0, None

    def add(c):
        nonlocal begin
        if begin is None and c.strip():
            begin = len(text[:i].encode())
        now.append(c)

    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote != "`" and i + 1 < len(text):
                add(c)
                i += 1
                c = text[i]
            elif c == quote:
                quote = None
            add(c)
        elif c in "'\"`":
            quote = c
            add(c)
        elif c == "#" or text.startswith("--", i):
            end = text.find("\n", i)
            i = (end if end >= 0 else len(text)) - 1
            add(" ")
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = (end + 1) if end >= 0 else len(text)
            add(" ")
        elif c == ";":
            out.append((begin, True, "".join(now)))
            now, begin = [], None
        else:
            add(c)
        i += 1
    out.append((begin, False, "".join(now)))
    return [(b, ended, t.split()) for b, ended, t in out if t.strip()]


PIECES = ["'", '"', "`", ";", "--", "#", "/*", "*/", "\n", "\r\n", "\\", "''", "(", ")", "a", "ä", " ", "INSERT INTO t VALUES (1,'x;y');\n", "'it''s;'", "\"a'b\"", "-", "/", "*", "-- it's\n", "/* ' */", "1,2\n"]


def test_lines_of_any_text_equal_the_plain_reader():
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 40)))
        state, found, held = statements.NORMAL, [], []
        for line in text.encode().split(b"\n"):
            parts, state = statements.parts_of_line(line, state)
            for a, b, ends in parts:
                held.append(line[a:b] + (b" " if b < len(line) else b""))
                if ends:
                    found.append((True, b"".join(held).decode().split()))
                    held = []
            held.append(b"\n")
        found.append((False, b"".join(held).decode().split()))
        assert [f for f in found if f[1]] == [(ended, words) for _, ended, words in plain_statements(text)], text


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "97b")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def some_dump(seed, n=80):
    rnd = random.Random(seed)
    return "".join(rnd.choice(PIECES[17:] + ["INSERT INTO t VALUES (1,\n'two\nlines; -- no'),\n", "INSERT /* x\n; ' \n*/ INTO t VALUES (2);\n", "a" * 150, "\n"]) for _ in range(n))


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_statements_of_many_ranges(spark, tmp_path, small_ranges, monkeypatch, bound):
    """With the ranges' states broadcast, and joined by a shuffle."""
    monkeypatch.setattr(statements, "RANGES", bound)
    want = []
    for k in range(4):
        text = some_dump(k)
        (tmp_path / f"{k}.sql").write_bytes(text.encode())
        want += [(f"{k}.sql", b, ended, tuple(t)) for b, ended, t in plain_statements(text)]
    found = statements.statements(spark, f"{tmp_path}/*.sql")
    assert statements.ranges(spark, f"{tmp_path}/*.sql").count() > 40
    got = [(r["file"].rsplit("/", 1)[1], r["offset"], r["ended"], tuple(r["text"].split())) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_quoted_text_of_many_ranges_stays_as_it_is(spark, tmp_path, small_ranges):
    values = [(k, f"a;\n-- {k}\r\n'' /* \\' it's\n" * (k % 4)) for k in range(40)]
    lists = ",".join("({},'{}')".format(k, v.replace("\\", "\\\\").replace("'", "''")) for k, v in values)
    (tmp_path / "one.sql").write_bytes(f"/* it's */ INSERT INTO t (k, v) VALUES {lists}; INSERT INTO u (k) VALUES (1)".encode())
    assert statements.ranges(spark, f"{tmp_path}/one.sql").count() > 10
    assert rows(dump.read_insert_dump(spark, f"{tmp_path}/one.sql", "t").select(F.col("k").cast("long"), "v")) == sorted(values, key=repr)
    assert rows(dump.read_insert_dump(spark, f"{tmp_path}/one.sql", "u")) == [("1",)]


def test_statements_and_comments_on_one_line(spark, tmp_path):
    text = "INSERT INTO t (a,b) VALUES (1,'x'); INSERT INTO t (a,b) VALUES (2,'y');-- it's\n/* it's */INSERT INTO t (a,b) VALUES (3,'z') /* ; */, (4,NULL -- no ')'\n);"
    (tmp_path / "a.sql").write_text(text)
    assert rows(dump.read_insert_dump(spark, f"{tmp_path}/a.sql", "t")) == [("1", "x"), ("2", "y"), ("3", "z"), ("4", None)]
    assert rows(dump.dump_row_counts(spark, f"{tmp_path}/a.sql")) == [("t", 4)] and dump.dump_rejects(spark, f"{tmp_path}/a.sql").count() == 0


def test_values_with_prefixes_and_calls(spark, tmp_path):
    text = """REPLACE INTO db.`t` VALUES (_binary 'a,b', 0xAB, NOW(), CAST('x)' AS CHAR(3)), -1.5e3, "it's ""q\"\"", 'p''q', '');
INSERT IGNORE INTO t (c0, c1) VALUES (1, 2), (3) ON DUPLICATE KEY UPDATE c0 = VALUES(c0);"""
    (tmp_path / "v.sql").write_text(text)
    got = [r[0] for r in dump._inserts(spark, f"{tmp_path}/v.sql").select(F.explode(dump.tuples(F.col("body")))).select(F.transform(dump.fields(F.col("col")), literal_text)).collect()]
    assert sorted(got, key=repr) == sorted([["a,b", "0xAB", "NOW()", "CAST('x)' AS CHAR(3))", "-1.5e3", 'it\'s "q"', "p'q", ""], ["1", "2"], ["3"]], key=repr)
    # Short lists are filled with nulls.
    assert ("3", None) in rows(dump.read_insert_dump(spark, f"{tmp_path}/v.sql", "t"))
    assert dump.dump_rejects(spark, f"{tmp_path}/v.sql").count() == 0


def test_rejects_have_their_place_and_add_up(spark, tmp_path):
    text = "-- ü\nINSERT INTO t (a,b) VALUES (1,'x'),(2,'y',3),(4,;\n INSERT INTO t SELECT 1;\nINSERT INTO t (a,b) VALUES (5,'z'), (6, 'cut"
    (tmp_path / "r.sql").write_text(text)
    got = rows(dump.dump_rejects(spark, f"{tmp_path}/r.sql").select("offset", "table", "reason", "n_rows_kept", "text"))
    first, second, third = (len(text[: text.index(x)].encode()) for x in ("INSERT INTO t (a,b) VALUES (1", "INSERT INTO t SELECT", "INSERT INTO t (a,b) VALUES (5"))
    assert got == sorted([(first, "t", "incomplete list", 2, "(4,"), (first, "t", "values without a name", 2, "(2,'y',3)"), (second, "t", "no lists", 0, "INSERT INTO t SELECT 1"), (third, "t", "incomplete list", 1, "(6, 'cut")], key=repr)
    kept = {(r["file"], r["offset"]): r["n_rows_kept"] for r in dump.dump_rejects(spark, f"{tmp_path}/r.sql").collect()}
    assert sum(kept.values()) == dump.read_insert_dump(spark, f"{tmp_path}/r.sql", "t").count() == 3
