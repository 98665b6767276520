"""Script collections as tables of statements, datasets, flows and settings.

Input is ``scripts(path, text)``, optionally with ``library`` (see
``sources.scripts``). A script is one row, so splitting it, classifying its
statements and attaching settings to flows all happen inside that row. Only
numbering flows across files needs the order of the whole collection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import script_text as st
from millrace.operators.windows import numbered
from millrace.settings import SIZES, spark_conf
from millrace.storage import stored


def statements(scripts: DataFrame) -> DataFrame:
    """``(path, statement_no, statement)``, numbered from 1 within each file."""
    return scripts.select(
        *_place(scripts), F.posexplode(st.statements(F.col("text"))).alias("position", "statement")
    ).select(*_place(scripts), (F.col("position") + 1).alias("statement_no"), "statement")


def classified(scripts: DataFrame) -> DataFrame:
    """``(path, statement_no, kind, target, body, write)``; settings and unsupported text have no target."""
    found = statements(scripts).withColumn("head", st.head(F.col("statement")))
    return _described(found).select(*_place(scripts), "statement_no", "kind", "target", "body", "write")


def declarations(scripts: DataFrame) -> DataFrame:
    """``(path, statement_no, statement, kind, target, body, write, inputs, conf)``.

    One row per statement other than a setting; ``conf`` holds the settings
    made since the statement before it. Settings that no statement follows
    appear as rows of kind ``set``. ``inputs`` keeps the order in which they
    are first mentioned.
    """
    return _declared(_groups(scripts)).drop("sets", "head")


def declared_flows(scripts: DataFrame) -> DataFrame:
    """The declarations that fill a dataset: ``(path, statement_no, kind, target, body, write, inputs, conf)``."""
    return _declared(_groups(scripts).filter(F.col("head") != "")).drop("sets", "head", "statement")


def filling_statements(scripts: DataFrame) -> DataFrame:
    """``declared_flows`` without ``conf``, for which nothing but the filling statements has to be looked at."""
    parts = F.filter(_parts(), lambda s: s["head"] != "")
    found = scripts.select(*_place(scripts), F.explode(parts).alias("s")).select(*_place(scripts), "s.*")
    return _described(found).withColumn("inputs", st.input_names(F.col("body"))).drop("head", "statement")


def unsupported_statements(scripts: DataFrame) -> DataFrame:
    """``(path, statement_no, statement)`` of everything that declares nothing."""
    found = statements(scripts).withColumn("kind", st.kind(F.col("statement"), st.shape(st.head(F.col("statement")))))
    return found.filter(F.col("kind") == st.UNSUPPORTED).drop("kind")


def flow_inputs(scripts: DataFrame) -> DataFrame:
    """``(path, statement_no, target, input_no, input)`` in first-seen order."""
    return _exploded_inputs(scripts, F.col("inputs"))


def outside_flow_inputs(scripts: DataFrame) -> DataFrame:
    """As ``flow_inputs``, without the names a query defines in its own ``WITH`` list."""
    return _exploded_inputs(scripts, st.outside_inputs(F.col("inputs"), F.col("body")))


def flow_settings(scripts: DataFrame) -> DataFrame:
    """``(path, statement_no, key, value)``: the settings of each flow."""
    return (
        declared_flows(scripts)
        .select(*_place(scripts), "statement_no", F.explode_outer("conf").alias("c"))
        .filter(F.col("c").isNotNull())
        .select(*_place(scripts), "statement_no", "c.key", "c.value")
    )


def dangling_settings(scripts: DataFrame) -> DataFrame:
    """``(path, statement_no, key, value)`` of settings that no statement follows."""
    return (
        declarations(scripts)
        .filter(F.col("kind") == st.SET)
        .select(*_place(scripts), "statement_no", st.setting(F.col("statement")).alias("c"))
        .select(*_place(scripts), "statement_no", "c.key", "c.value")
    )


def flow_numbers(flows: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Add ``flow_no``, counting across all files in path order, and the name ``flow``; columns in ``drop`` go.

    ``flows`` is read twice (once for the bounds of the sort) and sorted as it
    is, so it should be stored and narrow.
    """
    return numbered(flows, _order(flows), "flow_no", drop).withColumn("flow", st.flow_name(F.col("flow_no"), F.col("target")))


def numbered_flows(scripts: DataFrame) -> DataFrame:
    """``declared_flows`` with ``flow_no`` and ``flow``; the scripts are taken apart once, bodies are not sorted."""
    flows = stored(declared_flows(scripts), "flows")
    place = [*_place(scripts), "statement_no"]
    return flows.join(flow_numbers(flows.select(*place, "target")).drop("target"), place)


def declaration_tables(scripts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables ``(datasets, flows, flow_inputs)`` that ``lineage`` and ``checks`` work on.

    ``datasets`` has a row for every declaration of a name, not only the first.
    Names stay as written. An input comes with the target and the number of its flow, once.
    """
    outside = st.outside_inputs(F.col("inputs"), F.col("body")).alias("inputs")
    narrow = filling_statements(scripts).select(*_place(scripts), "statement_no", "target", "kind", outside)
    with spark_conf(scripts.sparkSession, SIZES):
        place = [*_place(scripts), "statement_no"]
        found = flow_numbers(stored(narrow, "declarations"), drop=place)
    datasets = found.select(F.col("target").alias("name"), "kind", F.col("flow_no").alias("decl_no"))
    flows = found.select("flow", "target", F.lit("batch").alias("mode"), F.col("flow_no").alias("decl_no"))
    return datasets, flows, found.select("flow", "target", F.explode("inputs").alias("dataset"), F.col("flow_no").alias("decl_no"))


def by_number(declared: DataFrame) -> DataFrame:
    """Flows or inputs of ``declaration_tables`` with ``decl_no`` as ``flow``: a number is sorted and hashed much faster than a name."""
    return declared.withColumn("flow", F.col("decl_no"))


def by_name(numbers: DataFrame) -> DataFrame:
    """What was found of flows ``by_number``, ``flow`` as name again; it needs their ``target``."""
    return numbers.withColumn("flow", st.flow_name(F.col("flow"), F.col("target")))


def project_rows(scripts: DataFrame) -> DataFrame:
    """``declarations`` of one project, their inputs without names defined in the query."""
    found = declarations(scripts).withColumn("inputs", st.outside_inputs(F.col("inputs"), F.col("body")))
    return found.withColumn("place", F.struct(*_order(scripts)))


def first_declarations(scripts: DataFrame) -> DataFrame:
    """``(target, kind, write, path, statement_no)``: the first statement that names each dataset."""
    first = F.min_by(F.struct("kind", "write", "path", "statement_no"), F.struct(*_order(scripts)))
    return filling_statements(scripts).groupBy("target").agg(first.alias("first")).select("target", "first.*")


def _exploded_inputs(scripts: DataFrame, names: Column) -> DataFrame:
    # The outer form, since Spark tests the array of the plain one in a filter and so computes it twice.
    return (
        filling_statements(scripts)
        .select(*_place(scripts), "statement_no", "target", F.posexplode_outer(names).alias("position", "input"))
        .filter(F.col("input").isNotNull())
        .select(*_place(scripts), "statement_no", "target", (F.col("position") + 1).alias("input_no"), "input")
    )


def _place(scripts: DataFrame) -> list[str]:
    return ["path", "library"] if "library" in scripts.columns else ["path"]


def _order(scripts: DataFrame) -> list[str]:
    return [*_place(scripts)[::-1], "statement_no"]


def _parts() -> Column:
    return F.transform(
        st.statements(F.col("text")),
        lambda s, i: F.struct((i + 1).alias("statement_no"), st.head(s).alias("head"), s.alias("statement")),
    )


def _groups(scripts: DataFrame) -> DataFrame:
    cut = scripts.select(*_place(scripts), _parts().alias("parts"))
    marked = cut.withColumn(
        "others",
        F.filter("parts", lambda s: (s["head"] != "") | ~s["statement"].rlike(st.SET_CONF)),
    )
    ends = marked.withColumn("ends", F.concat(F.array(F.lit(0)), F.col("others.statement_no")))
    groups = ends.select(*_place(scripts), F.explode(F.concat(_with_settings(), _trailing())).alias("s"))
    return groups.select(*_place(scripts), "s.*")


def _declared(groups: DataFrame) -> DataFrame:
    return (
        _described(groups)
        .withColumn("sets", F.transform("sets", st.setting))
        .withColumn("conf", st.last_settings("sets"))
        .withColumn("inputs", st.input_names(F.col("body")))
    )


def _described(found: DataFrame) -> DataFrame:
    """Add kind, target, body and way of writing to rows with ``statement`` and ``head``."""
    statement, head, shape = F.col("statement"), F.col("head"), F.col("shape")
    return found.withColumn("shape", st.shape(head)).withColumns(
        {
            "kind": st.kind(statement, shape),
            "target": st.target(shape),
            "body": st.body(statement, head),
            "write": st.write_mode(shape),
        }
    ).drop("shape")


def _with_settings() -> Column:
    """Each statement that is no setting, with the settings since the one before.

    ``parts`` are all statements, ``others`` those that are no settings, and
    ``ends`` the numbers of the latter after a leading 0.
    """

    def attach(statement: Column, position: Column) -> Column:
        end = F.get("ends", position)
        return _group(statement, F.slice("parts", end + 1, statement["statement_no"] - end - 1))

    return F.transform("others", attach)


def _trailing() -> Column:
    """The settings after the last other statement, as statements of their own."""
    rest = F.slice("parts", F.element_at("ends", -1) + 1, F.size("parts"))
    return F.transform(rest, lambda statement: _group(statement, F.slice("parts", 1, 0)))


def _group(statement: Column, sets: Column) -> Column:
    names = ("statement_no", "head", "statement")
    return F.struct(*[statement[n].alias(n) for n in names], F.transform(sets, lambda s: s["statement"]).alias("sets"))
