"""Collections of scripts and declarations that Spark derives from the test tables.

Each is one SELECT in the SQL that Spark and DuckDB share, with table names in
braces, so both engines start from the same rows. Sizes follow the tables: a
script per order and per document, a flow per order, customer, part, supplier
and line item.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

class Piece(NamedTuple):
    """One statement of a script, every field an SQL expression over its table; what a reader should find is known here.

    ``before`` and ``after`` are text around the statement that does not belong
    to it, ``when`` says which rows have it.
    """

    kind: str
    body: str
    head: str = "''"
    target: str = "NULL"
    inputs: tuple[str, ...] = ()
    defined: tuple[str, ...] = ()
    key: str = "NULL"
    value: str = "NULL"
    before: str = "''"
    after: str = "';' || chr(10)"
    when: str = "true"

    @property
    def statement(self) -> str:
        return f"{self.head} || {self.body}"


Q = "chr(39)"
N = "chr(10)"

ORDER_PIECES = (
    Piece(
        "set",
        "'SET spark.sql.shuffle.partitions=' || o_custkey",
        key="'spark.sql.shuffle.partitions'",
        value="CAST(o_custkey AS STRING)",
        before=f"'-- depot ' || o_orderpriority || ': don' || {Q} || 't stop; \"here' || {N}",
        when="o_orderstatus <> 'F'",
    ),
    Piece(
        "set",
        "'set  spark.sql.files.maxPartitionBytes = \"64m\"'",
        key="'spark.sql.files.maxPartitionBytes'",
        value="'64m'",
        when="o_orderstatus = 'P'",
    ),
    Piece(
        "set",
        f"'Set spark.sql.shuffle.partitions = ' || {Q} || '17' || {Q}",
        key="'spark.sql.shuffle.partitions'",
        value="'17'",
        after=f"' ; ;' || {N}",
        when="o_orderstatus = 'P'",
    ),
    Piece(
        "temporary_view",
        f"'select b.id, ' || {Q} || 'join ghost_' || o_custkey || '; don' || {Q} || {Q} || 't' || {Q} || ' as remark'"
        f" || {N} || 'from `raw`.`boxes ' || o_orderstatus || '` b left join ref . carrier_' || o_custkey"
        " || ' r on r.id = b.id'",
        head=f"'create or replace temporary view `load` . `box_' || o_orderkey || '` as' || {N}",
        target="'load.box_' || o_orderkey",
        inputs=("'raw.boxes ' || o_orderstatus", "'ref.carrier_' || o_custkey"),
        before="'/* load; from nothing_' || o_custkey || ' */ '",
    ),
    Piece("unsupported", "'UPDATE load.box_' || o_orderkey || ' SET id = 0'", when="o_orderpriority = '1-URGENT'"),
    Piece(
        "materialized_view",
        f"'WITH box AS (SELECT * FROM load.box_' || o_orderkey || ' WHERE remark <> ' || {Q} || 'a;b)' || {Q}"
        f" || '), weights (id) AS (SELECT (id) FROM weights JOIN box ON true)' || {N}"
        " || 'SELECT count(*) AS n FROM box JOIN weights ON (box.id = weights.id)'",
        head="'CREATE MATERIALIZED VIEW out.sum$' || o_custkey || ' AS '",
        target="'out.sum$' || o_custkey",
        inputs=("'load.box_' || o_orderkey", "'weights'"),
        defined=("'box'",),
        before=f"'-- totals; by carrier' || {N}",
        after=f"' -- end; of it' || {N} || ';' || {N}",
    ),
    Piece(
        "table",
        "'Select n From out.sum$' || o_custkey || ' x Join OUT.sum$' || o_custkey || ' y On true'",
        head="'Insert Into Table `sink`.`sums ' || o_orderstatus || '` '",
        target="'sink.sums ' || o_orderstatus",
        inputs=("'out.sum$' || o_custkey", "'OUT.sum$' || o_custkey"),
    ),
    # Two flows that read each other and one behind them: none can ever start.
    Piece(
        "materialized_view",
        "'SELECT id FROM ring.b_' || o_orderkey",
        head="'CREATE MATERIALIZED VIEW ring.a_' || o_orderkey || ' AS '",
        target="'ring.a_' || o_orderkey",
        inputs=("'ring.b_' || o_orderkey",),
        when="o_orderstatus = 'P'",
    ),
    Piece(
        "materialized_view",
        "'SELECT id FROM ring.a_' || o_orderkey",
        head="'CREATE MATERIALIZED VIEW ring.b_' || o_orderkey || ' AS '",
        target="'ring.b_' || o_orderkey",
        inputs=("'ring.a_' || o_orderkey",),
        when="o_orderstatus = 'P'",
    ),
    Piece(
        "table",
        "'SELECT id FROM ring.b_' || o_orderkey",
        head="'INSERT INTO ring.all '",
        target="'ring.all'",
        inputs=("'ring.b_' || o_orderkey",),
        when="o_orderstatus = 'P'",
    ),
    Piece(
        "set",
        "'SET late.key=' || o_custkey",
        key="'late.key'",
        value="CAST(o_custkey AS STRING)",
        after=N,
        when="o_orderpriority = '5-LOW'",
    ),
)

DOCUMENT_PIECES = (
    Piece(
        "temporary_view",
        f"'SELECT ' || {Q} || replace(text, {Q}, {Q} || {Q}) || {Q} || ' AS words FROM raw.pages_' || lang",
        head="'CREATE TEMPORARY VIEW page_' || doc_id || ' AS '",
        target="'page_' || doc_id",
        inputs=("'raw.pages_' || lang",),
        before=f"'/* ' || replace(text, '*/', '* /') || ' */' || {N}",
    ),
    Piece(
        "table",
        "'SELECT words FROM page_' || doc_id",
        head="'INSERT INTO pages.`all` '",
        target="'pages.all'",
        inputs=("'page_' || doc_id",),
    ),
    Piece(
        "table",
        f"'SELECT ' || {Q} || 'never closed; ' || replace(text, {Q}, ' ') || '.'",
        head="'INSERT INTO pages.open '",
        target="'pages.open'",
        after="''",
        when="lang = 'de'",
    ),
)

ORDER_PATH = "'depot/' || o_orderpriority || '/' || lpad(CAST(o_orderkey AS STRING), 19, '0') || '.sql'"
DOCUMENT_PATH = "'depot/pages/' || lpad(CAST(doc_id AS STRING), 19, '0') || '.sql'"


def _text(pieces: tuple[Piece, ...]) -> str:
    return " || ".join(
        f"CASE WHEN {p.when} THEN {p.before} || {p.statement} || {p.after} ELSE '' END" for p in pieces
    )


SCRIPTS = f"""
SELECT {ORDER_PATH} AS path, {_text(ORDER_PIECES)} AS text FROM {{orders}}
UNION ALL
SELECT {DOCUMENT_PATH}, {_text(DOCUMENT_PIECES)} FROM {{documents}}
"""


def _found(number: int, piece: Piece, path: str, source: str) -> str:
    write = {"table": "'insert'", "set": "NULL", "unsupported": "NULL"}.get(piece.kind, "'save'")
    body = piece.body if piece.target != "NULL" else "NULL"
    lists = [", ".join(names) for names in (piece.inputs, piece.inputs + piece.defined)]
    return f"""
SELECT {path} AS path, {number} AS place, {piece.statement} AS statement, '{piece.kind}' AS kind,
  CAST({piece.target} AS VARCHAR) AS target, CAST({write} AS VARCHAR) AS "write", CAST({body} AS VARCHAR) AS body,
  CAST([{lists[0]}] AS VARCHAR[]) AS outside, CAST([{lists[1]}] AS VARCHAR[]) AS named,
  CAST({piece.key} AS VARCHAR) AS key, CAST({piece.value} AS VARCHAR) AS value
FROM {source} WHERE {piece.when}"""


# What has to be found in the scripts, built from the same pieces without looking at the scripts' text.
FOUND = " UNION ALL ".join(
    [_found(i, p, ORDER_PATH, "orders") for i, p in enumerate(ORDER_PIECES)]
    + [_found(i, p, DOCUMENT_PATH, "documents") for i, p in enumerate(DOCUMENT_PIECES)]
)

# A valid estate: orders feed a table per customer, customers feed nations,
# nations regions, and everything one summary.
SALES_DATASETS = """
SELECT 'orders_of_' || c_custkey AS name, 'table' AS kind, c_custkey AS decl_no FROM {customer}
UNION ALL
SELECT 'cust_' || c_custkey, 'materialized_view', 1000000000000000 + c_custkey FROM {customer}
UNION ALL
SELECT 'nation_' || n_nationkey, 'materialized_view', CAST(2000000000000000 + n_nationkey AS BIGINT) FROM {nation}
UNION ALL
SELECT 'region_' || r_regionkey, 'temporary_view', CAST(3000000000000000 + r_regionkey AS BIGINT) FROM {region}
UNION ALL
SELECT DISTINCT 'world', 'materialized_view', CAST(4000000000000000 AS BIGINT) FROM {region}
"""

SALES_FLOWS = """
SELECT 'load_order_' || o_orderkey AS flow, 'orders_of_' || o_custkey AS target,
  CASE WHEN o_orderstatus = 'F' THEN 'once' ELSE 'batch' END AS mode, o_orderkey AS decl_no FROM {orders}
UNION ALL
SELECT 'build_cust_' || c_custkey, 'cust_' || c_custkey, 'batch', 1000000000000000 + c_custkey FROM {customer}
UNION ALL
SELECT 'build_nation_' || n_nationkey, 'nation_' || n_nationkey, 'batch',
  CAST(2000000000000000 + n_nationkey AS BIGINT) FROM {nation}
UNION ALL
SELECT 'build_region_' || r_regionkey, 'region_' || r_regionkey, 'batch',
  CAST(3000000000000000 + r_regionkey AS BIGINT) FROM {region}
UNION ALL
SELECT DISTINCT 'build_world', 'world', 'batch', CAST(4000000000000000 AS BIGINT) FROM {region}
"""

SALES_INPUTS = """
SELECT 'load_order_' || o_orderkey AS flow, 'raw_orders' AS dataset FROM {orders}
UNION ALL
SELECT 'load_order_' || o_orderkey, 'raw_priority_' || o_orderpriority FROM {orders}
UNION ALL
SELECT 'build_cust_' || c_custkey, 'orders_of_' || c_custkey FROM {customer}
UNION ALL
SELECT 'build_cust_' || c_custkey, 'raw_customers' FROM {customer}
UNION ALL
SELECT 'build_nation_' || c_nationkey, 'cust_' || c_custkey FROM {customer}
UNION ALL
SELECT 'build_region_' || n_regionkey, 'nation_' || n_nationkey FROM {nation}
UNION ALL
SELECT 'build_world', 'region_' || r_regionkey FROM {region}
UNION ALL
SELECT 'build_world', 'nation_' || n_nationkey FROM {nation}
"""

# An estate with every kind of mistake.
STOCK_DATASETS = """
SELECT 'supplier_' || s_suppkey AS name, 'materialized_view' AS kind, s_suppkey AS decl_no
FROM {supplier} WHERE s_acctbal > 0
UNION ALL
SELECT CASE WHEN p_type = 'ECONOMY' THEN 'stock.part_' ELSE 'part_' END || p_partkey,
  CASE WHEN p_size < 10 THEN 'temporary_view' WHEN p_size < 30 THEN 'materialized_view' ELSE 'table' END,
  1000000000000000 + p_partkey FROM {part}
UNION ALL
SELECT 'pack_' || p_name, CASE WHEN p_size < 25 THEN 'materialized_view' ELSE 'table' END,
  2000000000000000 + p_partkey FROM {part}
"""

STOCK_FLOWS = """
SELECT 'load_supplier_' || s_suppkey AS flow, 'supplier_' || s_suppkey AS target,
  CASE WHEN s_acctbal > 9000 THEN 'once' ELSE 'batch' END AS mode, s_suppkey AS decl_no FROM {supplier}
UNION ALL
SELECT 'reload_supplier_' || s_suppkey, 'supplier_' || s_suppkey, 'batch', 1000000000000000 + s_suppkey
FROM {supplier} WHERE s_nationkey < 5
UNION ALL
SELECT 'fill_pack_' || p_name, 'pack_' || p_name, 'batch', 2000000000000000 + p_partkey FROM {part}
UNION ALL
SELECT 'receive_' || l_orderkey || '_' || l_linenumber, 'part_' || l_partkey,
  CASE WHEN l_returnflag = 'R' THEN 'once' ELSE 'batch' END, 3000000000000000 + l_orderkey * 10 + l_linenumber
FROM {lineitem}
"""

# A deep graph: a flow per part reads the dataset of half its number; parts of
# size 50 are read back by that flow, which closes cycles.
CHAIN_FLOWS = """
SELECT 'flow_' || (p_partkey + 1) AS flow, 'data_' || (p_partkey + 1) AS target, 'batch' AS mode,
  p_partkey + 1 AS decl_no FROM {part}
"""

CHAIN_INPUTS = """
SELECT 'flow_' || (p_partkey + 1) AS flow,
  'data_' || CAST(floor((p_partkey + 1) / 2.0) AS BIGINT) AS dataset FROM {part}
UNION ALL
SELECT 'flow_' || CAST(floor((p_partkey + 1) / 2.0) AS BIGINT), 'data_' || (p_partkey + 1)
FROM {part} WHERE p_size = 50 AND p_partkey > 0
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")


def derive(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Run one of the queries above over the Parquet tables in ``sf_dir``.

    Long texts take much more work than their few rows in a file show, so documents are dealt out to all tasks.
    """
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in query}
    if "documents" in used:
        used["documents"] = used["documents"].select("doc_id", "text", "lang").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(query, **used)


def as_sql(query: str) -> str:
    """The same query over tables of those names."""
    return query.format(**{t: t for t in TABLES})
