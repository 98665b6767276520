"""Run a pipeline: order its flows, apply settings, publish, report."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import (
    INSERT,
    MATERIALIZED_VIEW,
    ONCE,
    SOURCE_FILE,
    STATEMENT_INDEX,
    TABLE,
    Dataset,
    Flow,
    Pipeline,
    PipelineError,
)
from millrace.functions.script_text import FLOW_NAME_FORMAT, FLOW_NAME_REPLACED, SET, UNSUPPORTED
from millrace.plans.scripts import project_rows
from millrace.settings import default_namespace, own_session, spark_conf
from millrace.sinks.publish import bootstrap, counted, publish, split_name, take_back
from millrace.sources.scripts import read_scripts
from millrace.streaming.guard import require_batch


@dataclass(frozen=True)
class FlowContext:
    """What a flow's query sees: the session, its pipeline and reading by name."""

    spark: SparkSession
    pipeline: Pipeline

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)


class FlowResult(NamedTuple):
    """One published flow; ``rows`` is None where nothing was written (views, skipped writes)."""

    stage: int
    flow: str
    target: str
    rows: int | None


class _OtherSession(PipelineError):
    """A query that did not use the session it was given, so that the flow's settings would not reach its job."""


class _HeldBack(PipelineError):
    """A flow that was not run because another writer of its table failed."""


def stages(pipeline: Pipeline) -> Iterator[list[Flow]]:
    """Flows in waves: a flow comes one wave after the last writer of any of its inputs."""
    writers = pipeline.writers()
    upstream = {
        f.name: {w.name for name in f.inputs for w in writers.get(pipeline.key(name), ())} for f in pipeline.flows
    }
    sorter = TopologicalSorter(upstream)
    try:
        sorter.prepare()
    except CycleError as error:
        raise PipelineError(f"flows depend on each other in a cycle: {' -> '.join(error.args[1])}") from error
    while sorter.is_active():
        ready = set(sorter.get_ready())
        yield [f for f in pipeline.flows if f.name in ready]
        sorter.done(*ready)


def run(
    spark: SparkSession,
    pipeline: Pipeline,
    save_mode: str = "overwrite",
    max_concurrent_flows: int = 1,
    once_log: str | None = None,
) -> list[FlowResult]:
    """Publish every flow of ``pipeline`` in dependency order and list what was done.

    ``save_mode`` applies to the first flow of this run that saves into a
    target; further flows into the same table append, so several writers add
    up instead of erasing each other. With ``once_log``, a table name, ``once``
    flows recorded there by an earlier run are skipped.

    Flows of one wave may run side by side, but for those that write the same
    table. Flows with settings of their own then run in sessions of their own,
    which start with the settings, views and functions of the caller's. Those
    into views, which run no job, and those whose query answers with data of
    another session than ``context.spark`` run alone after the others.

    If a flow fails, the rest of its wave still finishes except for further
    writers of the same table, which might add to rows of an earlier run; later
    waves do not start, and the first failure is raised.

    A ``once`` flow that is recorded runs again with the others if this run
    overwrites its table, since its rows would be lost otherwise.

    If the driver ends between a ``once`` flow's write and its record, the flow
    runs again. Where its dataset has a ``run_column``, the attempt was noted
    beforehand in the table ``once_log`` + ``_begun``, and its rows are taken back
    first; elsewhere they are there twice. One run of a pipeline at a time.
    """
    _require_valid(pipeline)
    waves = list(stages(pipeline))
    context = FlowContext(spark, pipeline)
    done: list[FlowResult] = []
    started: dict[str, str | None] = {}
    failed: set[str] = set()
    with spark_conf(spark, pipeline.conf), default_namespace(spark, pipeline.catalog, pipeline.database):
        recorded = _recorded(spark, pipeline, once_log)
        _take_back(spark, pipeline, recorded, once_log)
        skipped = _skipped(pipeline, recorded, save_mode)
        for number, wave in enumerate(waves):
            flows = [f for f in wave if f.name not in skipped]
            modes = {}
            for flow in flows:
                key = pipeline.key(flow.target)
                if key not in started:
                    started[key] = _first_mode(spark, pipeline.dataset(flow.target), save_mode)
                    modes[flow.name] = started[key]
                else:
                    modes[flow.name] = "append" if started[key] else None

            marks = {f.name: uuid.uuid4().hex for f in flows if pipeline.dataset(f.target).run_column}
            _begin(spark, pipeline, flows, marks, once_log)

            def one(
                flow: Flow, own: bool = False, number: int = number, modes: dict = modes, marks: dict = marks
            ) -> FlowResult:
                return _run_flow(context, flow, number, modes[flow.name], marks.get(flow.name), own)

            outcomes = _run_wave(spark, pipeline, flows, one, max_concurrent_flows, failed)
            if once_log:
                _record(spark, pipeline, [f for f in flows if isinstance(outcomes[f.name], FlowResult)], once_log)
            # The cause comes before the flows that were held back for it.
            for cause in (True, False):
                for flow in flows:
                    outcome = outcomes[flow.name]
                    if isinstance(outcome, Exception) and cause != isinstance(outcome, _HeldBack):
                        raise PipelineError(f"flow {flow.name!r} failed: {outcome}") from outcome
            done += [outcomes[flow.name] for flow in flows]
    return done


def plan(spark: SparkSession, pipeline: Pipeline) -> DataFrame:
    """What ``run`` would do, as rows ``(pipeline, stage, flow, target)``; nothing is executed.

    Missing tables and mistakes inside query texts show only in a run.
    """
    _require_valid(pipeline)
    rows = [(pipeline.name, n, f.name, f.target) for n, wave in enumerate(stages(pipeline)) for f in wave]
    return spark.createDataFrame(rows, "pipeline string, stage int, flow string, target string")


def report(spark: SparkSession, results: Iterable[FlowResult]) -> DataFrame:
    """The results as rows ``(seq, stage, flow, target, rows)``.

    ``rows`` comes from the committed files (see ``sinks.publish.counted``).
    """
    rows = [(seq, *result) for seq, result in enumerate(results, start=1)]
    return spark.createDataFrame(rows, "seq int, stage int, flow string, target string, rows bigint")


def load_project(
    spark: SparkSession,
    name: str,
    directories: list[str],
    catalog: str | None = None,
    database: str | None = None,
    conf: Mapping[str, str] | None = None,
) -> Pipeline:
    """Build a pipeline from folders of ``.sql`` files that all executors can read."""
    pipeline = from_scripts(name, read_scripts(spark, directories), catalog, database, conf)
    if not pipeline.flows:
        raise PipelineError(f"no SQL flows were found in {', '.join(directories)}")
    return pipeline


def from_scripts(
    name: str,
    scripts: DataFrame,
    catalog: str | None = None,
    database: str | None = None,
    conf: Mapping[str, str] | None = None,
) -> Pipeline:
    """Build a pipeline from rows ``(path, text)``.

    The scripts are taken apart by the same Spark jobs that serve whole script
    collections (``millrace.plans.scripts``); what comes back to the driver is
    the flow list of this one project, which the driver has to submit anyway.
    """
    datasets: dict[str, Dataset] = {}
    flows: list[Flow] = []
    for row in sorted(project_rows(scripts).collect(), key=lambda r: tuple(r.place)):
        if row.kind == SET:
            raise PipelineError(f"SET statements in {row.path} must be followed by a flow statement")
        if row.kind == UNSUPPORTED:
            raise PipelineError(f"unsupported SQL statement in {row.path}: {row.statement}")
        number = len(flows) + 1
        stored_as = "parquet" if row.kind == MATERIALIZED_VIEW else None
        place = {SOURCE_FILE: row.path, STATEMENT_INDEX: str(number)}
        dataset = datasets.setdefault(row.target, Dataset(row.target, row.kind, row.write, stored_as, properties=place))
        if dataset.kind != row.kind:
            raise PipelineError(f"{row.target!r} is a {dataset.kind} and, in {row.path}, also a {row.kind}")
        flow = FLOW_NAME_FORMAT % (number, re.sub(FLOW_NAME_REPLACED, "_", row.target))
        conf_of = {c.key: c.value for c in row.conf}
        flows.append(Flow(flow, row.target, _sql_query(row.body), tuple(row.inputs), conf=conf_of))
    return Pipeline(name, tuple(datasets.values()), tuple(flows), catalog, database, conf or {})


def _require_valid(pipeline: Pipeline) -> None:
    problems = pipeline.problems()
    if problems:
        raise PipelineError(f"pipeline {pipeline.name!r} is not valid: " + "; ".join(problems))


def _sql_query(body: str):
    return lambda context: context.sql(body)


def _first_mode(spark: SparkSession, dataset: Dataset, save_mode: str) -> str | None:
    """Prepare a target before its first write; None means an existing table is left alone."""
    if not dataset.persisted or dataset.write == INSERT:
        return save_mode
    if spark.catalog.tableExists(dataset.name):
        return None if save_mode == "ignore" else save_mode
    if bootstrap(spark, dataset) and save_mode != "overwrite":
        return "append"
    return save_mode


def _run_wave(
    spark: SparkSession,
    pipeline: Pipeline,
    flows: list[Flow],
    one: Callable[..., FlowResult],
    max_concurrent_flows: int,
    failed: set[str],
) -> dict[str, FlowResult | Exception]:
    """What became of each flow. ``failed`` collects the tables of failed writers, which take no more rows."""
    outcomes: dict[str, FlowResult | Exception] = {}

    def attempt(group: list[Flow], together: bool = False) -> None:
        for flow in group:
            key = pipeline.key(flow.target)
            if key in failed:
                outcomes[flow.name] = _HeldBack(f"another writer of {flow.target!r} failed")
                continue
            try:
                outcomes[flow.name] = one(flow, together and bool(flow.conf))
            except _OtherSession:
                return
            except Exception as error:
                outcomes[flow.name] = error
                failed.add(key)

    by_target: dict[str, list[Flow]] = {}
    for flow in flows:
        by_target.setdefault(pipeline.key(flow.target), []).append(flow)
    persisted = {k for k in by_target if pipeline.dataset(k).persisted}
    groups = [group for key, group in by_target.items() if key in persisted or not any(f.conf for f in group)]
    if max_concurrent_flows > 1 and len(groups) > 1:
        side_by_side = inheritable_thread_target(spark)(lambda group: attempt(group, together=True))
        with ThreadPoolExecutor(max_concurrent_flows) as pool:
            list(pool.map(side_by_side, groups))
    attempt([f for f in flows if f.name not in outcomes])
    return outcomes


def _run_flow(
    context: FlowContext, flow: Flow, stage: int, mode: str | None, mark: str | None = None, own: bool = False
) -> FlowResult:
    """Run one flow; with ``own`` in a session of its own, whose settings nobody else sees."""
    if own:
        context, outer = replace(context, spark=own_session(context.spark)), context.spark
    spark, dataset = context.spark, context.pipeline.dataset(flow.target)
    with spark_conf(spark, flow.conf):
        df = require_batch(flow.query(context), flow.name)
        if own and df.sparkSession is not spark:
            raise _OtherSession(flow.name)
        rows = None
        if not dataset.persisted:
            publish(dataset, df)
        elif mode is not None:
            rows = counted(dataset, df.withColumn(dataset.run_column, F.lit(mark)) if mark else df, mode)
    if own:
        outer.catalog.refreshTable(dataset.name)
    return FlowResult(stage, flow.name, dataset.name, rows)


def _recorded(spark: SparkSession, pipeline: Pipeline, once_log: str | None) -> set[str]:
    """The ``once`` flows of this pipeline that an earlier run has finished; read once per run."""
    if not once_log or not spark.catalog.tableExists(once_log):
        return set()
    known = {f.name for f in pipeline.flows if f.mode == ONCE}
    marks = spark.table(once_log).filter((F.col("pipeline") == pipeline.name) & F.col("flow").isin(*known))
    return {row["flow"] for row in marks.select("flow").distinct().collect()}


def _skipped(pipeline: Pipeline, recorded: set[str], save_mode: str) -> set[str]:
    """The recorded flows, but for those whose table other flows of this run overwrite."""
    skipped: set[str] = set()
    for key, writers in pipeline.writers().items():
        own = {f.name for f in writers} & recorded
        dataset = pipeline.dataset(key)
        overwritten = save_mode == "overwrite" and dataset is not None and dataset.write != INSERT
        if own and not (overwritten and len(own) < len(writers)):
            skipped |= own
    return skipped


def _record(spark: SparkSession, pipeline: Pipeline, flows: list[Flow], once_log: str) -> None:
    """Add the finished ``once`` flows of a wave to the log, in one write of the driver's thread."""
    marks = [(pipeline.name, f.name) for f in flows if f.mode == ONCE]
    if marks:
        rows = spark.createDataFrame(marks, "pipeline string, flow string")
        publish(Dataset(once_log, TABLE), rows, "append")


def _begun_log(once_log: str) -> str:
    *where, name = split_name(once_log)
    return ".".join(f"`{p}`" for p in [*where, f"{name}_begun"])


def _begin(spark: SparkSession, pipeline: Pipeline, flows: list[Flow], marks: Mapping[str, str], once_log: str | None) -> None:
    """Note the attempts of a wave's ``once`` flows before anything is written."""
    begun = [(pipeline.name, f.name, marks[f.name]) for f in flows if f.mode == ONCE and f.name in marks]
    if once_log and begun:
        rows = spark.createDataFrame(begun, "pipeline string, flow string, mark string")
        publish(Dataset(_begun_log(once_log), TABLE), rows, "append")


def _take_back(spark: SparkSession, pipeline: Pipeline, recorded: set[str], once_log: str | None) -> None:
    """Remove the rows of ``once`` flows that were begun and never recorded."""
    marked = [f for f in pipeline.flows if f.mode == ONCE and pipeline.dataset(f.target).run_column]
    open_flows = {f.name: pipeline.dataset(f.target) for f in marked if f.name not in recorded}
    if not once_log or not open_flows or not spark.catalog.tableExists(_begun_log(once_log)):
        return
    begun = spark.table(_begun_log(once_log)).filter(F.col("pipeline") == pipeline.name)
    for row in begun.filter(F.col("flow").isin(*open_flows)).select("flow", "mark").distinct().collect():
        take_back(spark, open_flows[row["flow"]], [row["mark"]])
