import duckdb
import pandas as pd
import pytest

from tessella.llm import threads
from tessella.llm.queries import op3_threads

from ..compare import connect, rows_of_duckdb, rows_of_spark

SCHEMA = "conv_id long, turn long, role string, text string"
FIRST = "Where is the boat?\nIt was here, yesterday."
ROWS = [
    (1, 0, "user", FIRST),
    (1, 1, "assistant", "> Where is the boat?\n> It was here, yesterday.\nAt the lake."),
    (1, 2, "user", "On Monday, a wrote:\n>> where is THE boat\n>> it was here   yesterday\n> At the lake.\nThank you."),
    (1, 3, "assistant", "> nobody said this\nStill here."),
    (1, 4, "user", ">  It was here yesterday\n> and more\nOne line of it."),
    (1, 5, "user", ">>> Where is the boat?\nDeep only."),
    (1, 6, "user", "> At the lake.\n\n> Thank you.\ntwo quotes"),
    (1, 7, "user", "> later words\nx"),
    (1, 8, "user", "later words"),
    (2, 0, "user", "> Where is the boat?\nanother conversation"),
    (2, 1, "user", None),
    (2, 1, "user", None),
    (2, 2, None, ""),
    (3, None, "user", "> a\nno turn"),
    (None, 1, "user", "no conversation"),
    (4, 0, "user", "same"),
    (4, 1, "user", "same"),
    (4, 2, "user", "> same"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return {(r.conv_id, r.turn): r for r in threads.format_threads(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()}


@pytest.mark.parametrize(
    ("turn", "parent", "root", "depth", "quoted", "linked"),
    [(0, None, 0, 0, 0, 0), (1, 0, 0, 1, 1, 1), (2, 1, 0, 2, 2, 2), (3, None, 3, 0, 1, 0), (4, 0, 0, 1, 1, 1), (5, 0, 0, 1, 1, 1), (6, 2, 0, 3, 2, 2), (7, None, 7, 0, 1, 0), (8, None, 8, 0, 0, 0)],
)
def test_links(rows, turn, parent, root, depth, quoted, linked):
    r = rows[1, turn]
    assert (r.parent_turn, r.root_turn, r.depth, r.quoted, r.linked) == (parent, root, depth, quoted, linked)


def test_texts_are_without_quotations(rows):
    assert rows[1, 0].text == FIRST and rows[1, 1].text == "At the lake." and rows[1, 2].text == "Thank you." and rows[4, 2].text == ""
    assert rows[1, 1].formatted == "<|assistant|>\nAt the lake.\n" and rows[2, 2].formatted == "<|unknown|>\n\n"
    assert rows[4, 2].parent_turn == 0 and rows[2, 0].linked == 0 and len(rows) == len(set(ROWS))


def test_fixture_equals_sql(spark):
    con = duckdb.connect()
    frame = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("frame", frame)
    con.execute("create view conversations as select conv_id::bigint conv_id, turn::bigint turn, role, text from frame")
    assert rows_of_spark(threads.format_threads(spark.createDataFrame(ROWS, SCHEMA))) == rows_of_duckdb(con, threads.SQL)


def test_long_chain_and_order(spark):
    chain = [(9, i, "user", f"> word {i - 1}\nword {i}") for i in range(40)]
    got = threads.format_threads(spark.createDataFrame(chain, SCHEMA)).collect()
    assert [(r.turn, r.depth, r.root_turn) for r in got] == [(i, i, 0) for i in range(40)]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], SCHEMA + ", root long")
    assert threads.format_threads(df).count() == len(set(ROWS))
    assert threads.format_threads(df.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    assert rows_of_spark(op3_threads(spark, sf)) == rows_of_duckdb(connect(sf), threads.SQL)


def test_plan_has_no_python(spark):
    plan = threads.format_threads(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct"))
