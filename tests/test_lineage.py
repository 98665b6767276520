from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace import storage
from millrace.plans import checks, lineage
from millrace.plans.scripts import declaration_tables


def tables(spark, flows, inputs):
    declared = [(f, t, m, i) for i, (f, t, m) in enumerate(flows)]
    return (
        spark.createDataFrame(declared, "flow string, target string, mode string, decl_no bigint"),
        spark.createDataFrame(inputs, "flow string, dataset string"),
    )


@pytest.fixture
def chain(spark):
    return tables(
        spark,
        [("seed", "source", "batch"), ("clean", "clean", "batch"), ("daily", "daily", "batch")],
        [("clean", "source"), ("clean", "outside"), ("daily", "clean"), ("daily", "clean")],
    )


def test_chain(chain):
    assert rows(lineage.edges(*chain)) == [("clean", "daily"), ("seed", "clean")]
    assert rows(lineage.external_inputs(*chain)) == [("clean", "outside")]
    levels = lineage.stage_levels(*chain)
    assert rows(levels) == [("clean", 1), ("daily", 2), ("seed", 0)]
    assert rows(lineage.degrees(*chain)) == [("clean", 1, 1), ("daily", 1, 0), ("seed", 0, 1)]
    assert rows(lineage.blocked_flows(chain[0], levels)) == []
    listing = lineage.plan_listing("p", chain[0], levels).collect()
    assert [tuple(r) for r in listing] == [("p", 0, "seed", "source"), ("p", 1, "clean", "clean"), ("p", 2, "daily", "daily")]


def test_readers_wait_for_all_writers(spark):
    graph = tables(
        spark,
        [("w1", "sink", "batch"), ("w2", "sink", "batch"), ("a", "a", "batch"), ("out", "out", "batch")],
        [("w2", "a"), ("out", "sink")],
    )
    assert rows(lineage.stage_levels(*graph)) == [("a", 0), ("out", 2), ("w1", 0), ("w2", 1)]
    assert rows(lineage.producers(graph[0]).filter("dataset = 'sink'")) == [("sink", 1, "w1"), ("sink", 2, "w2")]


def test_cycles_block_what_is_behind_them(spark):
    graph = tables(
        spark,
        [("a", "a", "batch"), ("b", "b", "batch"), ("behind", "c", "batch"), ("own", "o", "batch"), ("free", "f", "batch")],
        [("a", "b"), ("b", "a"), ("behind", "a"), ("own", "o"), ("free", "outside")],
    )
    levels = lineage.stage_levels(*graph)
    assert rows(levels) == [("free", 0)]
    blocked = lineage.blocked_flows(graph[0], levels)
    assert rows(blocked) == [("a",), ("b",), ("behind",), ("own",)]
    assert {r[0] for r in rows(checks.blocked(blocked))} == {"cycle"}


def test_a_long_chain_takes_few_jobs(spark, monkeypatch):
    n, writes = 1000, []
    stored = lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda df, label: (writes.append(label), stored(df, label))[1])
    flows = spark.range(n).select(
        F.concat(F.lit("f"), "id").alias("flow"), F.concat(F.lit("d"), "id").alias("target"), F.lit("batch").alias("mode"), F.col("id").alias("decl_no")
    )
    inputs = flows.filter("decl_no > 0").select("flow", F.concat(F.lit("d"), F.col("decl_no") - 1).alias("dataset"))
    assert dict(rows(lineage.stage_levels(flows, inputs))) == {f"f{i}": i for i in range(n)}
    assert len(writes) < 30


def cycles_by_hand(flows, inputs):
    level, up = levels_by_hand(flows, inputs)
    reach = {f: set(us) for f, us in up.items()}
    changed = True
    while changed:
        changed = False
        for f in reach:
            more = set().union(reach[f], *(reach[u] for u in reach[f]))
            changed, reach[f] = changed or more != reach[f], more
    return {f: min((u for u in reach[f] if f in reach[u]), default=None) for f in up if f not in level}


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_cycles_are_named(spark, seed):
    rng = random.Random(seed)
    flows = [(f"f{i}", f"d{rng.randint(0, 30)}", "batch") for i in range(60)]
    inputs = [(f, f"d{rng.randint(0, 40)}") for f, _, _ in flows for _ in range(rng.choice((0, 1, 1, 2)))]
    inputs += [(f, t) for f, t, _ in flows[:2]]
    if seed == 4:
        # A ring of 300, a tail behind it, and a ring behind that.
        flows += [(f"r{i}", f"ring{i}", "batch") for i in range(300)] + [(f"t{i}", f"tail{i}", "batch") for i in range(20)]
        inputs += [(f"r{i}", f"ring{(i - 1) % 300}") for i in range(300)] + [(f"t{i}", f"tail{i - 1}" if i else "ring7") for i in range(20)]
        flows += [("x1", "x1", "batch"), ("x2", "x2", "batch")]
        inputs += [("x1", "x2"), ("x2", "x1"), ("x1", "tail19")]
    expected = cycles_by_hand(flows, inputs)
    assert dict(rows(lineage.cycles(*tables(spark, flows, inputs)))) == expected
    assert any(expected.values()) and None in expected.values()


def test_a_cycle_through_a_hub_with_many_readers(spark):
    n = 100_000
    readers = spark.range(n).select(F.concat(F.lit("r"), "id").alias("flow"), F.concat(F.lit("d"), "id").alias("target"))
    flows = readers.unionAll(spark.createDataFrame([("back", "hub")], "flow string, target string"))
    flows = flows.withColumns({"mode": F.lit("batch"), "decl_no": F.lit(1).cast("bigint")})
    inputs = readers.select("flow", F.lit("hub").alias("dataset")).unionAll(spark.createDataFrame([("back", "d5")], "flow string, dataset string"))
    found = lineage.cycles(flows, inputs)
    assert rows(found.filter("cycle_id IS NOT NULL")) == [("back", "back"), ("r5", "back")]
    assert found.count() == n + 1


def test_hubs_are_the_edges_without_their_product(spark):
    n = 100_000
    writers = spark.range(n).select(F.concat(F.lit("w"), "id").alias("flow"), F.lit("hub").alias("target"))
    readers = spark.range(n).select(F.concat(F.lit("r"), "id").alias("flow"), F.concat(F.lit("d"), "id").alias("target"))
    flows = writers.unionAll(readers).withColumns({"mode": F.lit("batch"), "decl_no": F.lit(1).cast("bigint")})
    inputs = readers.select("flow", F.lit("hub").alias("dataset"))
    assert rows(lineage.hubs(flows, inputs).groupBy("dataset", "side").count()) == [("hub", "reader", n), ("hub", "writer", n)]
    assert rows(lineage.stage_levels(flows, inputs).groupBy("stage").count()) == [(0, n), (1, n)]


def test_nothing_declared(spark):
    graph = tables(spark, [], [])
    assert rows(lineage.stage_levels(*graph)) == []
    assert rows(lineage.cycles(*graph)) == []


def test_what_hangs_from_a_placed_dataset_is_placed_with_it(spark):
    graph = tables(
        spark,
        [("a", "a", "batch"), ("b", "b", "batch"), ("c", "c", "batch"), ("d", "d", "batch"), ("e", "e", "batch")],
        [("b", "a"), ("c", "b"), ("d", "c"), ("d", "b"), ("e", "d")],
    )
    assert rows(lineage.stage_levels(*graph)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]


def levels_by_hand(flows, inputs):
    writers = {}
    for f, t, _ in flows:
        writers.setdefault(t, set()).add(f)
    up = {f: set() for f, _, _ in flows}
    for f, d in inputs:
        up[f] |= writers.get(d, set())
    level, number = {}, 0
    while True:
        ready = [f for f in up if f not in level and all(u in level for u in up[f])]
        if not ready:
            return level, up
        level |= dict.fromkeys(ready, number)
        number += 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    flows = [(f"f{i}", f"d{rng.randint(0, 40)}", "batch") for i in range(60)]
    inputs = []
    for name, target, _ in flows:
        for _ in range(rng.randint(0, 2)):
            low = 0 if rng.random() < 0.03 else int(target[1:]) + 1
            inputs.append((name, f"d{rng.randint(low, 45)}"))
    expected, up = levels_by_hand(flows, inputs)
    graph = tables(spark, flows, inputs)
    assert dict(rows(lineage.stage_levels(*graph))) == expected
    edges = set(rows(lineage.edges(*graph)))
    assert edges == {(u, f) for f, us in up.items() for u in us}
    for flow, n_up, n_down in rows(lineage.degrees(*graph)):
        assert n_up == len(up[flow]) and n_down == sum(1 for u, _ in edges if u == flow)


def test_a_popular_table_does_not_multiply_the_work(spark):
    """Half of the flows fill one table and the other half read it: pairs would be 4 million."""
    n = 2000
    writers = spark.range(n).select(
        F.concat(F.lit("w"), "id").alias("flow"), F.lit("hub").alias("target"), F.lit("batch").alias("mode"), F.col("id").alias("decl_no")
    )
    readers = spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("flow"), F.concat(F.lit("d"), "id").alias("target"), F.lit("batch").alias("mode"), F.col("id").alias("decl_no")
    )
    inputs = readers.select("flow", F.lit("hub").alias("dataset"))
    flows = writers.unionAll(readers)
    levels = lineage.stage_levels(flows, inputs)
    assert rows(levels.groupBy("stage").count()) == [(0, n), (1, n)]
    assert rows(lineage.degrees(flows, inputs).groupBy("n_upstream", "n_downstream").count()) == [(0, n, n), (n, 0, n)]


def test_every_check(spark):
    datasets = spark.createDataFrame(
        [
            ("idle", "table", 1),
            ("view", "materialized_view", 2),
            ("temp", "temporary_view", 3),
            ("db.temp", "temporary_view", 4),
            ("twice", "table", 5),
            ("twice", "materialized_view", 6),
        ],
        "name string, kind string, decl_no bigint",
    )
    flows, _ = tables(
        spark,
        [
            ("a", "view", "batch"),
            ("b", "view", "batch"),
            ("c", "temp", "once"),
            ("d", "twice", "once"),
            ("e", "db.temp", "batch"),
            ("lost", "nowhere", "batch"),
            ("same", "twice", "batch"),
            ("same", "twice", "batch"),
        ],
        [],
    )
    assert rows(checks.all_checks(datasets, flows)) == [
        ("duplicate_dataset", "twice", "2"),
        ("duplicate_flow", "same", "2"),
        ("mixed_kinds", "twice", "materialized_view,table"),
        ("no_producer", "idle", "table"),
        ("once_mode", "c", "temp"),
        ("single_writer", "view", "2"),
        ("undefined_target", "lost", "nowhere"),
        ("view_name", "db.temp", "temporary_view"),
    ]


@pytest.mark.parametrize("job", [lineage.cycles, lineage.external_inputs, lineage.hubs, lineage.stage_levels, lineage.edges])
def test_jobs_run_with_tasks_of_few_bytes_and_broadcast_only_tiny_tables(spark, chain, monkeypatch, job):
    seen, before = [], {k: spark.conf.get(k, None) for k in lineage.SIZES}

    def noted(df, label):
        seen.append({k: spark.conf.get(k, None) for k in lineage.SIZES})
        return storage.stored(df, label)

    monkeypatch.setattr(lineage, "stored", noted)
    job(*chain)
    assert seen and all(settings == lineage.SIZES for settings in seen)
    assert {k: spark.conf.get(k, None) for k in lineage.SIZES} == before


def test_inputs_that_nothing_writes_do_not_meet_the_writers(spark):
    flows = [(f"f{i}", f"t{i % 7}", "batch") for i in range(70)]
    inputs = [(f"f{i}", "raw") for i in range(70)] + [("f8", "t2"), ("f8", "t2"), ("f9", None)]
    found = tables(spark, flows, inputs)
    assert rows(lineage._readers(*found)) == [("t2", "f8")]
    assert rows(lineage.edges(*found)) == sorted((f"f{i}", "f8") for i in range(2, 70, 7))


def test_inputs_that_come_with_their_target_do_not_meet_the_flows(spark, monkeypatch):
    scripts = spark.createDataFrame(
        [
            ("a.sql", "INSERT INTO x SELECT 1; INSERT INTO y SELECT 1 FROM x JOIN x JOIN far; INSERT INTO p SELECT 1 FROM q"),
            ("b.sql", "INSERT INTO q SELECT 1 FROM p; INSERT INTO z SELECT 1 FROM y JOIN x; INSERT INTO w SELECT 1 FROM q JOIN x"),
        ],
        "path string, text string",
    )
    flows, inputs = (storage.stored(t, "given") for t in declaration_tables(scripts)[1:])
    plain = rows(lineage.stage_levels(flows, inputs.select("flow", "dataset")))
    plans, store = {}, lineage.stored

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, label)

    monkeypatch.setattr(lineage, "stored", noted)
    assert rows(lineage.stage_levels(flows, inputs)) == plain == [("sql_flow_001_x", 0), ("sql_flow_002_y", 1), ("sql_flow_005_z", 2)]
    assert plans["reads"].count("Join ") == 1 and plans["stage-levels"].count("Join ") == 1


def test_all_checks_find_what_each_check_finds(spark):
    datasets = spark.createDataFrame(
        [("a", "table", 3), ("a", "temporary_view", 1), ("v.w", "temporary_view", 4), ("idle", "table", 5), ("x", None, 6), (None, "table", 7), ("m", "materialized_view", 8)]
        + [("k", k, i) for i, k in enumerate(["table", None, "materialized_view", "table"])],
        "name string, kind string, decl_no int",
    )
    flows = spark.createDataFrame(
        [("f1", "a", "once"), ("f2", "a", "batch"), ("f2", "nobody", "batch"), ("f3", None, "once"), ("f4", "x", "batch"), (None, "m", "batch"), (None, "m", "once"), ("f5", "v.w", "batch")],
        "flow string, target string, mode string",
    ).withColumn("decl_no", F.lit(1))
    single = [checks.undefined_target, checks.no_producer, checks.single_writer, checks.once_mode, checks.duplicates]
    found = [r for check in single for r in rows(check(datasets, flows))] + rows(checks.mixed_kinds(datasets)) + rows(checks.view_name(datasets))
    # Among all checks, a dataset whose kind is null counts as one that nobody declared.
    found.append(("undefined_target", "f4", "x"))
    assert rows(checks.all_checks(datasets, flows)) == sorted(found, key=repr)


def test_checks_of_scripts_work_on_numbers(spark, monkeypatch, tmp_path):
    from millrace.flows import corpus, declarations
    from millrace.plans import scripts as ps

    orders = [(i, i % 3, "POF"[i % 3], "5-LOW") for i in range(12)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    documents = [(i, f"text {i} ", "de" if i % 2 else "en") for i in range(40)]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = corpus.derive(spark, str(tmp_path), "SELECT text FROM {documents}").groupBy(F.spark_partition_id()).count()
    assert len(rows(sizes)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    types, plans, store = {}, {}, storage.stored

    def noted(df, label):
        types.setdefault(label, dict(df.dtypes))
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    for module in (lineage, checks, ps):
        monkeypatch.setattr(module, "stored", noted)
    found = declarations.chk_scripts(spark, str(tmp_path))
    assert {t for label in ("edges", "degrees", "moved", "levels") for n, t in types[label].items() if n in ("up", "down", "dataset", "root")} == {"bigint"}
    assert types["stage-levels"] == {"flow": "bigint", "stage": "int"} and "flows" not in types
    assert "ObjectHashAggregate" not in plans["names"] and "SortAggregate" not in plans["names"]
    cycles = [r for r in rows(found) if r[0] == "cycle"]
    assert len(cycles) == 12 and {r[2] for r in cycles} == {"never ready"} and all(r[1].startswith("sql_flow_0") for r in cycles)


def test_names_of_flows_keep_their_form(spark):
    from millrace.functions import script_text as st

    given = [(n, t) for n in (None, 1, 99, 100, 12345) for t in (None, "a b.c$d", "plain-1")]
    df = spark.createDataFrame(given, "n bigint, t string").select("n", "t", st.flow_name(F.col("n"), F.col("t")).alias("name"))
    formed = F.format_string("sql_flow_%03d_%s", "n", F.regexp_replace("t", "[^A-Za-z0-9_.-]", "_"))
    assert df.filter(~F.col("name").eqNullSafe(formed)).count() == 0
