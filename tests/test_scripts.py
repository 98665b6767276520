from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace import PipelineError, from_scripts, load_project
from millrace.functions import script_text as st
from millrace.plans import scripts as ps
from millrace.sources.scripts import read_scripts

MIXED = '''/* harbour; tides */ Create Temp View `port` . `tide` As
Select t.at, "level; in ""cm""" As label, 'join nowhere; isn''t' As remark
From sea.`gauge 7` t Inner Join ref.moon On t.at = ref.moon.at -- ; high and low
;
insert into log.tides select label from port.tide where remark not in ('from x', 'a--b') -- end'''


def one(spark, text, path="a.sql"):
    return spark.createDataFrame([(path, text)], "path string, text string")


def listed(spark, text):
    return [r.statement for r in ps.statements(one(spark, text)).orderBy("statement_no").collect()]


def test_quotes_and_comments_do_not_cut(spark):
    view, insert = ps.declared_flows(one(spark, MIXED)).orderBy("statement_no").collect()
    assert (view.kind, view.write, view.target) == ("temporary_view", "save", "port.tide")
    assert view.inputs == ["sea.gauge 7", "ref.moon"]
    assert view.body.startswith("Select t.at") and view.body.endswith("ref.moon.at") and "isn''t" in view.body
    assert (insert.kind, insert.write, insert.target) == ("table", "insert", "log.tides")
    assert insert.inputs == ["port.tide"] and insert.body.endswith("('from x', 'a--b')")


def test_blank_statements_are_dropped(spark):
    assert listed(spark, " ;; \n/* none */;insert into a select 1\n ; -- over") == ["insert into a select 1"]
    assert listed(spark, "") == [] and listed(spark, " \t\n;;") == []


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a 'x;--y' b; c", ["a 'x;--y' b", "c"]),
        ('a "x;/*" b; c', ['a "x;/*" b', "c"]),
        ("a `x;` b; c", ["a `x;` b", "c"]),
        ("a -- it's; \n b; c", ["a \n b", "c"]),
        ("a /* ' ; */ b; c", ["a  b", "c"]),
        ("a/*/ ; */b", ["ab"]),
        ("a - b / c; d", ["a - b / c", "d"]),
        ("a 'open ; b", ["a 'open ; b"]),
        ("a /* open ; b", ["a"]),
        ("a '' ; b", ["a ''", "b"]),
        ("a ''';''' ; b", ["a ''';'''", "b"]),
    ],
)
def test_cutting(spark, text, expected):
    assert listed(spark, text) == expected


def cut_by_hand(text):
    """Character by character, as a check of the regular expressions."""
    out, cur, quote, i = [], "", None, 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if quote is None and two == "--":
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        if quote is None and two == "/*":
            end = text.find("*/", i + 2)
            if end < 0:
                break
            i = end + 2
            continue
        if quote is None and c == ";":
            out.append(cur)
            cur = ""
        else:
            cur += c
            if quote is None and c in "'\"`":
                quote = c
            elif c == quote:
                quote = None
        i += 1
    return [s for s in (piece.strip(st.BLANKS) for piece in [*out, cur]) if s]


def test_cutting_random_text(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab ;;'\"`-/*\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", st.statements(F.col("text")).alias("s"))
    got = {r.id: r.s for r in df.collect()}
    for i, text in enumerate(texts):
        assert got[i] == cut_by_hand(text), text


def test_very_long_literals(spark):
    text = "INSERT INTO t SELECT '" + "it''s ; -- " * 200_000 + "' FROM x; SELECT 2"
    first, second = listed(spark, text)
    assert len(first) == len(text) - len("; SELECT 2") and second == "SELECT 2"


def test_settings_belong_to_the_next_flow(spark):
    text = """set spark.sql.ansi.enabled = true; Set x.y='it''s'; set x.y = "late" ;
      create temp view first as select 1;
      insert into second select * from first; SET none = ; set semi = ' ;'; create materialized view third as select 2"""
    found = {r.target: {c.key: c.value for c in r.conf} for r in ps.declared_flows(one(spark, text)).collect()}
    assert found == {
        "first": {"spark.sql.ansi.enabled": "true", "x.y": "late"},
        "second": {},
        "third": {"none": "", "semi": " ;"},
    }


def test_dangling_settings(spark):
    found = ps.dangling_settings(one(spark, "SET a=1; INSERT INTO t SELECT 1; SET b = 2; SET c = 3"))
    assert rows(found) == [("a.sql", 3, "b", "2"), ("a.sql", 4, "c", "3")]
    assert rows(ps.dangling_settings(one(spark, "SET a=1"))) == [("a.sql", 1, "a", "1")]
    with pytest.raises(PipelineError, match="must be followed by a flow statement"):
        from_scripts("p", one(spark, "SET a=1"))


@pytest.mark.parametrize(
    "text",
    [
        "DELETE FROM orders_source",
        "INSERT INTO t WITH x AS (SELECT 1) SELECT * FROM x",
        "INSERT OVERWRITE TABLE t SELECT 1",
        "INSERT INTO t PARTITION (d = 1) SELECT 1",
        "INSERT INTO t (a) SELECT 1",
        "INSERT INTO t SELECTED",
        "CREATE VIEW v AS SELECT 1",
        "CREATE TEMP VIEW IF NOT EXISTS v AS SELECT 1",
        "CREATE TEMP VIEW v COMMENT 'c' AS SELECT 1",
        "CREATE STREAMING TABLE s AS SELECT 1",
        "SELECT 1",
    ],
)
def test_unsupported_statements(spark, text):
    assert rows(ps.unsupported_statements(one(spark, text))) == [("a.sql", 1, text)]
    with pytest.raises(PipelineError, match="unsupported SQL statement in a.sql"):
        from_scripts("p", one(spark, text))


@pytest.mark.parametrize(
    ("text", "kind", "target", "body"),
    [
        ("create or replace temporary view v as select 1", "temporary_view", "v", "select 1"),
        ("CREATE  MATERIALIZED\nVIEW  a . `b c` AS\n(SELECT 1)", "materialized_view", "a.b c", "(SELECT 1)"),
        ("INSERT INTO SELECT SELECT 1", "table", "SELECT", "SELECT 1"),
        ("INSERT INTO TABLE SELECT 1", "table", "TABLE", "SELECT 1"),
        ("INSERT INTO TABLE TABLE SELECT 1", "table", "TABLE", "SELECT 1"),
        ("CREATE TEMP VIEW AS AS AS SELECT 1", "temporary_view", "AS", "AS SELECT 1"),
        ("INSERT INTO t$1.`a.b` SELECT(1)", "table", "t$1.`a.b`", "SELECT(1)"),
        ("insert into `M:x` . y\nselect 1", "table", "M:x.y", "select 1"),
        ("create temp view `a:b` as select 1", "temporary_view", "a:b", "select 1"),
        ("create\tmaterialized view t as\n\nselect 1", "materialized_view", "t", "select 1"),
    ],
)
def test_declaration_heads(spark, text, kind, target, body):
    (row,) = ps.classified(one(spark, text)).collect()
    assert (row.kind, row.target, row.body) == (kind, target, body)


def test_inputs(spark):
    text = """INSERT INTO t SELECT 'from x.y join z', a FROM `A`. `b` JOIN c
      JOIN c ON fromage JOIN d$1, e LEFT JOIN (SELECT * FROM f) WHERE xfrom g"""
    (row,) = ps.declared_flows(one(spark, text)).collect()
    assert row.inputs == ["A.b", "c", "d$1", "f"]


@pytest.mark.parametrize(
    ("query", "outside"),
    [
        ("WITH a AS (SELECT * FROM src), `b`(x, y) AS (SELECT * FROM A JOIN other) SELECT * FROM a JOIN B", ["other", "src"]),
        ("WITH trees AS (SELECT * FROM trees WHERE old) SELECT * FROM trees", ["trees"]),
        ("WITH RECURSIVE n AS (SELECT 1 UNION ALL SELECT * FROM n JOIN e) SELECT * FROM n", ["e"]),
        ("WITH a AS (SELECT 1 FROM b), b AS (SELECT 2) SELECT * FROM b", ["b"]),
        ("WITH a AS (SELECT f((1)) FROM (SELECT * FROM (SELECT * FROM s))) SELECT * FROM a JOIN db.a", ["db.a", "s"]),
        ("WITH a AS (SELECT ')' FROM q) SELECT * FROM a", ["q"]),
        ("SELECT * FROM w WINDOW v AS (ORDER BY k), w AS (ORDER BY z)", ["w"]),
        ("SELECT * FROM (WITH c AS (SELECT 1) SELECT * FROM c) JOIN c", ["c"]),
        ("WITH a AS (SELECT 1 FROM x SELECT * FROM a", ["a", "x"]),
        ("WITH a AS (SELECT 1), `c` AS (SELECT * FROM a JOIN c JOIN C), d AS (SELECT * FROM c) SELECT * FROM d JOIN s", ["C", "c", "s"]),
    ],
)
def test_names_defined_by_the_query_are_no_inputs(spark, query, outside):
    found = ps.outside_flow_inputs(one(spark, f"CREATE TEMP VIEW v AS {query}"))
    assert [r[-1] for r in rows(found.select("input"))] == outside


def test_flow_numbers_run_across_files(spark):
    scripts = spark.createDataFrame(
        [
            ("y/2.sql", "insert into `deep sea`.`crab$1` select 1; create materialized view shells as select 2"),
            ("x/1.sql", "Insert Into `deep sea`.crab$1 Select 3"),
        ],
        "path string, text string",
    )
    found = ps.numbered_flows(scripts).orderBy("flow_no")
    assert [r.flow for r in found.collect()] == [
        "sql_flow_001_deep_sea.crab_1",
        "sql_flow_002_deep_sea.crab_1",
        "sql_flow_003_shells",
    ]
    assert rows(ps.first_declarations(scripts)) == [
        ("deep sea.crab$1", "table", "insert", "x/1.sql", 1),
        ("shells", "materialized_view", "save", "y/2.sql", 2),
    ]


def test_folders_are_searched_in_order_without_repeats(spark, tmp_path):
    for name in ("b/2.sql", "b/x/1.SQL", "a/3.sql", "a/no.txt", "a/with space+plus%.sql"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"INSERT INTO t SELECT '{name}'")
    found = read_scripts(spark, [str(tmp_path / "b" / "x"), str(tmp_path / "b"), str(tmp_path / "a"), str(tmp_path / "b")])
    got = [(r.library, r.path.removeprefix(str(tmp_path))) for r in found.orderBy("library", "path").collect()]
    assert got == [(0, "/b/x/1.SQL"), (1, "/b/2.sql"), (2, "/a/3.sql"), (2, "/a/with space+plus%.sql")]
    pipeline = load_project(spark, "p", [str(tmp_path / "b"), str(tmp_path / "a")])
    assert [f.name for f in pipeline.flows] == [f"sql_flow_00{i}_t" for i in (1, 2, 3, 4)]
    uris = [f"file:{tmp_path}/b", f"{tmp_path}/b/x", f"file://{tmp_path}/b/"]
    assert read_scripts(spark, uris).count() == 2
    assert len(pipeline.datasets) == 1 and pipeline.datasets[0].properties["sql.source.file"].endswith("/b/2.sql")


def test_projects_need_scripts(spark, tmp_path):
    with pytest.raises(PipelineError, match="no SQL flows were found"):
        load_project(spark, "p", [str(tmp_path)])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_project(spark, "p", [str(tmp_path / "missing")])


def test_scripts_feed_lineage_and_checks(spark):
    from millrace.plans import checks, lineage

    scripts = spark.createDataFrame(
        [
            ("1.sql", "INSERT INTO c SELECT * FROM b JOIN raw"),
            ("2.sql", "CREATE TEMP VIEW a AS SELECT 1"),
            ("3.sql", "CREATE MATERIALIZED VIEW b AS WITH c AS (SELECT * FROM a) SELECT * FROM c; INSERT INTO a SELECT 2"),
        ],
        "path string, text string",
    )
    datasets, flows, inputs = ps.declaration_tables(scripts)
    assert rows(lineage.stage_levels(flows, inputs)) == [
        ("sql_flow_001_c", 2),
        ("sql_flow_002_a", 0),
        ("sql_flow_003_b", 1),
        ("sql_flow_004_a", 0),
    ]
    assert rows(lineage.external_inputs(flows, inputs)) == [("sql_flow_001_c", "raw")]
    assert rows(checks.all_checks(datasets, flows)) == [
        ("duplicate_dataset", "a", "2"),
        ("mixed_kinds", "a", "table,temporary_view"),
        ("single_writer", "a", "2"),
    ]


def test_resolved_names(spark):
    df = spark.createDataFrame([("Orders",), ("Shop.Orders",)], "n string")
    assert rows(df.select(st.resolved_name(F.col("n"), "Main"))) == [("main.orders",), ("shop.orders",)]
    assert rows(df.select(st.resolved_name(F.col("n")))) == [("orders",), ("shop.orders",)]
