"""Script analysis, lineage and checks over collections derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.flows import corpus
from millrace.flows.corpus import as_sql, derive
from millrace.flows.registry import query, table
from millrace.functions import script_text as st
from millrace.plans import checks, lineage, scripts
from millrace.storage import stored

_STATEMENTS = f"""
found AS ({corpus.FOUND}),
pieces AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place) AS statement_no FROM found),
flow_pieces AS (
  SELECT *, row_number() OVER (ORDER BY path, statement_no) AS flow_no
  FROM pieces WHERE kind NOT IN ('set', 'unsupported')),
inputs AS (
  SELECT path, statement_no, target, unnest(named) AS input, generate_subscripts(named, 1) AS input_no FROM flow_pieces),
outside AS (SELECT path, statement_no, target, unnest(outside) AS input FROM flow_pieces),
groups AS (
  SELECT *, count(CASE WHEN kind <> 'set' THEN 1 END)
    OVER (PARTITION BY path ORDER BY statement_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before
  FROM pieces),
settings AS (SELECT path, statement_no, before, key, value FROM groups WHERE kind = 'set'),
owners AS (SELECT path, statement_no, kind, before FROM groups WHERE kind <> 'set')
"""


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, corpus.SCRIPTS)


@query(f"WITH {_STATEMENTS} SELECT path, statement_no, statement FROM pieces")
def lin_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.statements(_scripts(spark, sf_dir)).withColumn("statement_no", F.col("statement_no").cast("bigint"))


@query(f'WITH {_STATEMENTS} SELECT path, statement_no, kind, target, body, "write" FROM pieces')
def lin_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.classified(_scripts(spark, sf_dir)).withColumn("statement_no", F.col("statement_no").cast("bigint"))


@query(f"WITH {_STATEMENTS} SELECT path, statement_no, target, input_no, input FROM inputs")
def lin_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts.flow_inputs(_scripts(spark, sf_dir))
    return found.withColumns({n: F.col(n).cast("bigint") for n in ("statement_no", "input_no")})


@query(f"WITH {_STATEMENTS} SELECT path, statement_no, target, input FROM outside")
def lin_inputs_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs without the names that a query defines in its own WITH list."""
    found = scripts.outside_flow_inputs(_scripts(spark, sf_dir)).drop("input_no")
    return found.withColumn("statement_no", F.col("statement_no").cast("bigint"))


@query("""
SELECT p_partkey, 'stock room.' || p_brand || '.part_' || p_partkey AS plain,
  'stock room.' || lower(p_brand) || '.part_' || p_partkey AS with_own,
  'own.pack_' || p_partkey AS resolved
FROM part""")
def lin_normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-quotes and blanks go; resolving lowers the case and adds the default database to plain names."""
    key = F.col("p_partkey").cast("string")
    written = F.concat(F.lit(" `stock room` . `"), "p_brand", F.lit("`\n.part_"), key, F.lit(" "))
    name = st.normalised_name(written)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        name.alias("plain"),
        st.resolved_name(name, "OWN").alias("with_own"),
        st.resolved_name(F.concat(F.lit("Pack_"), key), "OWN").alias("resolved"),
    )


@query(f"""
WITH {_STATEMENTS}
SELECT s.path, o.statement_no, s.key, max_by(s.value, s.statement_no) AS value
FROM settings s JOIN owners o ON s.path = o.path AND s.before + 1 = o.before
WHERE o.kind <> 'unsupported' GROUP BY s.path, o.statement_no, s.key""")
def lin_set_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts.flow_settings(_scripts(spark, sf_dir))
    return found.withColumn("statement_no", F.col("statement_no").cast("bigint"))


@query(f"""
WITH {_STATEMENTS}
SELECT s.path, s.statement_no, s.key, s.value FROM settings s
WHERE NOT EXISTS (SELECT 1 FROM owners o WHERE o.path = s.path AND o.statement_no > s.statement_no)""")
def lin_dangling_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts.dangling_settings(_scripts(spark, sf_dir))
    return found.withColumn("statement_no", F.col("statement_no").cast("bigint"))


@query(f"""
WITH {_STATEMENTS}
SELECT path, statement_no, target, flow_no,
  'sql_flow_' || printf('%03d', flow_no) || '_' || regexp_replace(target, '[^A-Za-z0-9_.-]', '_', 'g') AS flow
FROM flow_pieces""")
def lin_number_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = stored(scripts.filling_statements(_scripts(spark, sf_dir)).select("path", "statement_no", "target"), "flows")
    return scripts.flow_numbers(flows).withColumn("statement_no", F.col("statement_no").cast("bigint"))


@query(f"""
WITH {_STATEMENTS}
SELECT target, kind, "write", path, statement_no
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY flow_no) AS nth FROM flow_pieces) WHERE nth = 1""")
def lin_first_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts.first_declarations(_scripts(spark, sf_dir))
    return found.withColumn("statement_no", F.col("statement_no").cast("bigint"))


_SCRIPT_TABLES = f"""
{_STATEMENTS},
numbered AS (
  SELECT *, 'sql_flow_' || printf('%03d', flow_no) || '_' || regexp_replace(target, '[^A-Za-z0-9_.-]', '_', 'g') AS flow
  FROM flow_pieces)
"""


_SCRIPT_STEPS = """
edges AS (
  SELECT DISTINCT w.flow AS upstream, r.flow AS downstream
  FROM numbered w JOIN outside i ON w.target = i.input
  JOIN numbered r ON r.path = i.path AND r.statement_no = i.statement_no),
steps AS (
  SELECT flow, CAST(0 AS INTEGER) AS stage FROM numbered WHERE flow NOT IN (SELECT downstream FROM edges)
  UNION SELECT e.downstream, s.stage + 1 FROM steps s JOIN edges e ON e.upstream = s.flow)"""


@query(f"""
WITH RECURSIVE {_SCRIPT_TABLES}, {_SCRIPT_STEPS}
SELECT flow, max(stage) AS stage FROM steps GROUP BY flow""")
def lin_script_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From script texts to the stage of every flow."""
    _, flows, flow_inputs = scripts.declaration_tables(_scripts(spark, sf_dir))
    return lineage.stage_levels(flows, flow_inputs)


_SALES = f"""
datasets AS ({as_sql(corpus.SALES_DATASETS)}),
flows AS ({as_sql(corpus.SALES_FLOWS)}),
flow_inputs AS ({as_sql(corpus.SALES_INPUTS)}),
edges AS (
  SELECT DISTINCT f.flow AS upstream, i.flow AS downstream FROM flows f JOIN flow_inputs i ON f.target = i.dataset)
"""

_CHAIN = f"""
flows AS ({as_sql(corpus.CHAIN_FLOWS)}),
flow_inputs AS ({as_sql(corpus.CHAIN_INPUTS)}),
edges AS (
  SELECT DISTINCT f.flow AS upstream, i.flow AS downstream FROM flows f JOIN flow_inputs i ON f.target = i.dataset),
reach AS (
  SELECT upstream AS a, downstream AS b FROM edges
  UNION SELECT r.a, e.downstream FROM reach r JOIN edges e ON r.b = e.upstream),
loops AS (SELECT DISTINCT a AS flow FROM reach WHERE a = b),
blocked AS (SELECT flow FROM loops UNION SELECT b FROM reach JOIN loops ON a = flow)
"""

_LEVELS = """
steps AS (
  SELECT flow, CAST(0 AS INTEGER) AS stage FROM {nodes} WHERE flow NOT IN (SELECT downstream FROM edges)
  UNION SELECT e.downstream, s.stage + 1 FROM steps s JOIN edges e ON e.upstream = s.flow
  WHERE e.downstream IN (SELECT flow FROM {nodes})),
levels AS (SELECT flow, max(stage) AS stage FROM steps GROUP BY flow)
"""


def _sales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, sf_dir, corpus.SALES_FLOWS), derive(spark, sf_dir, corpus.SALES_INPUTS)


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, sf_dir, corpus.CHAIN_FLOWS), derive(spark, sf_dir, corpus.CHAIN_INPUTS)


@query(f"""
WITH {_SALES}
SELECT target AS dataset, row_number() OVER (PARTITION BY target ORDER BY decl_no, flow) AS producer_no, flow FROM flows""")
def lin_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.producers(_sales(spark, sf_dir)[0])


@query(f"WITH {_SALES} SELECT upstream, downstream FROM edges")
def lin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edges(*_sales(spark, sf_dir))


@query(f"""
WITH {_SALES}
SELECT flow, (SELECT count(*) FROM edges WHERE downstream = flow) AS n_upstream,
  (SELECT count(*) FROM edges WHERE upstream = flow) AS n_downstream
FROM flows""")
def lin_edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.degrees(*_sales(spark, sf_dir))


@query(f"""
WITH {_SALES}
SELECT DISTINCT flow, dataset FROM flow_inputs i WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.target = i.dataset)""")
def lin_external_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.external_inputs(*_sales(spark, sf_dir))


@query(f"WITH RECURSIVE {_SALES}, {_LEVELS.format(nodes='flows')} SELECT flow, stage FROM levels")
def lin_stage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.stage_levels(*_sales(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_CHAIN}, free AS (SELECT flow FROM flows WHERE flow NOT IN (SELECT flow FROM blocked)),
{_LEVELS.format(nodes='free')}
SELECT flow, stage FROM levels""")
def lin_stage_levels_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph as deep as the logarithm of the number of parts, with cycles that block some of it."""
    return lineage.stage_levels(*_chain(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_CHAIN},
mutual AS (SELECT x.a AS flow, min(x.b) AS cycle_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
SELECT DISTINCT blocked.flow, cycle_id FROM blocked LEFT JOIN mutual USING (flow)""")
def lin_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that can never start, with the name of their cycle; null for those behind one."""
    return lineage.cycles(*_chain(spark, sf_dir))


@query(f"""
WITH {_SALES}
SELECT target AS dataset, 'writer' AS side, flow FROM flows WHERE target IN (SELECT dataset FROM flow_inputs)
UNION ALL
SELECT DISTINCT dataset, 'reader', flow FROM flow_inputs WHERE dataset IN (SELECT target FROM flows)""")
def lin_edge_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.hubs(*_sales(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_SALES}, {_LEVELS.format(nodes='flows')}
SELECT 'sales' AS pipeline, stage, flows.flow, target FROM flows JOIN levels ON flows.flow = levels.flow""")
def lin_plan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows, flow_inputs = _sales(spark, sf_dir)
    return lineage.plan_listing("sales", flows, lineage.stage_levels(flows, flow_inputs))


_STOCK = f"""
datasets AS ({as_sql(corpus.STOCK_DATASETS)}),
flows AS ({as_sql(corpus.STOCK_FLOWS)}),
kinds AS (SELECT name, min_by(kind, decl_no) AS kind FROM datasets GROUP BY name)
"""

_UNDEFINED = """
SELECT 'undefined_target' AS "check", flow AS object, target AS detail FROM flows
WHERE target NOT IN (SELECT name FROM datasets)"""
_NO_PRODUCER = """
SELECT 'no_producer' AS "check", name AS object, kind AS detail FROM kinds WHERE name NOT IN (SELECT target FROM flows)"""
_SINGLE_WRITER = """
SELECT 'single_writer' AS "check", name AS object, CAST(count(*) AS VARCHAR) AS detail
FROM kinds JOIN flows ON target = name WHERE kind <> 'table' GROUP BY name HAVING count(*) > 1"""
_ONCE_MODE = """
SELECT 'once_mode' AS "check", flow AS object, target AS detail
FROM kinds JOIN flows ON target = name WHERE kind <> 'table' AND mode = 'once'"""
_DUPLICATES = """
SELECT 'duplicate_dataset' AS "check", name AS object, CAST(count(*) AS VARCHAR) AS detail
FROM datasets GROUP BY name HAVING count(*) > 1
UNION ALL
SELECT 'duplicate_flow', flow, CAST(count(*) AS VARCHAR) FROM flows GROUP BY flow HAVING count(*) > 1"""
_MIXED_KINDS = """
SELECT 'mixed_kinds' AS "check", name AS object, string_agg(kind, ',' ORDER BY kind) AS detail
FROM (SELECT DISTINCT name, kind FROM datasets) GROUP BY name HAVING count(*) > 1"""
_VIEW_NAME = """
SELECT 'view_name' AS "check", name AS object, kind AS detail FROM kinds
WHERE kind = 'temporary_view' AND contains(name, '.')"""
_ALL = " UNION ALL ".join(
    [_UNDEFINED, _NO_PRODUCER, _SINGLE_WRITER, _ONCE_MODE, _DUPLICATES, _MIXED_KINDS, _VIEW_NAME]
)


@query(f"""
WITH RECURSIVE {_SCRIPT_TABLES}, {_SCRIPT_STEPS},
datasets AS (SELECT target AS name, kind, flow_no AS decl_no FROM numbered),
flows AS (SELECT flow, target, 'batch' AS mode FROM numbered),
kinds AS (SELECT name, min_by(kind, decl_no) AS kind FROM datasets GROUP BY name)
{_ALL}
UNION ALL
SELECT 'cycle', flow, 'never ready' FROM flows WHERE flow NOT IN (SELECT flow FROM steps)""")
def chk_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From script texts to all that the checks find in them, flows that can never start included."""
    datasets, flows, flow_inputs = scripts.declaration_tables(_scripts(spark, sf_dir))
    numbers = scripts.by_number(flows)
    blocked = lineage.blocked_flows(numbers, lineage.stage_levels(numbers, scripts.by_number(flow_inputs)), "target")
    return checks.all_checks(datasets, flows).unionByName(checks.blocked(scripts.by_name(blocked)))


def _stock(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, sf_dir, corpus.STOCK_DATASETS), derive(spark, sf_dir, corpus.STOCK_FLOWS)


@query(f"WITH {_STOCK} {_UNDEFINED}")
def chk_undefined_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.undefined_target(*_stock(spark, sf_dir))


@query(f"WITH {_STOCK} {_NO_PRODUCER}")
def chk_no_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.no_producer(*_stock(spark, sf_dir))


@query(f"WITH {_STOCK} {_SINGLE_WRITER}")
def chk_single_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.single_writer(*_stock(spark, sf_dir))


@query(f"WITH {_STOCK} {_ONCE_MODE}")
def chk_once_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.once_mode(*_stock(spark, sf_dir))


@query(f"WITH {_STOCK} {_DUPLICATES}")
def chk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(*_stock(spark, sf_dir))


@query(f"WITH {_STOCK} {_MIXED_KINDS}")
def chk_mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.mixed_kinds(_stock(spark, sf_dir)[0])


@query(f"WITH {_STOCK} {_VIEW_NAME}")
def chk_view_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.view_name(_stock(spark, sf_dir)[0])


@query(f"WITH {_STOCK} {_ALL}")
def chk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.all_checks(*_stock(spark, sf_dir))
