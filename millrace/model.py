"""Pipeline declarations: immutable values, checked when built."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

TABLE = "table"
MATERIALIZED_VIEW = "materialized_view"
TEMPORARY_VIEW = "temporary_view"
KINDS = (TABLE, MATERIALIZED_VIEW, TEMPORARY_VIEW)

BATCH = "batch"
ONCE = "once"
MODES = (BATCH, ONCE)

SAVE = "save"
INSERT = "insert"
WRITES = (SAVE, INSERT)

# Properties of datasets that come from scripts.
SOURCE_FILE = "sql.source.file"
STATEMENT_INDEX = "sql.statement.index"


class PipelineError(Exception):
    """A pipeline that cannot be built, ordered or run."""


def _require(value: Any, what: str) -> None:
    if value is None or value == "":
        raise PipelineError(f"{what} is required")


def _choice(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise PipelineError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class Dataset:
    """A named result: a table, a fully refreshed materialized view or a temporary view.

    ``write="insert"`` marks a table that exists already and is appended to by
    column position; every other persisted dataset is saved by name.

    With ``run_column`` every row says which attempt of a flow wrote it, and
    the table is partitioned by that, so that ``run`` can take back what an
    interrupted ``once`` flow has left behind.
    """

    name: str
    kind: str
    write: str = SAVE
    format: str | None = None
    schema: StructType | None = None
    comment: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)
    run_column: str | None = None

    def __post_init__(self) -> None:
        _require(self.name, "dataset name")
        _choice(self.kind, KINDS, "dataset kind")
        _choice(self.write, WRITES, "dataset write")
        object.__setattr__(self, "properties", MappingProxyType(dict(self.properties)))

    @property
    def persisted(self) -> bool:
        return self.kind != TEMPORARY_VIEW


@dataclass(frozen=True)
class Flow:
    """A query that fills one dataset: ``query(context)`` returns a batch DataFrame."""

    name: str
    target: str
    query: Callable[[Any], DataFrame]
    inputs: tuple[str, ...] = ()
    mode: str = BATCH
    conf: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(self.name, "flow name")
        _require(self.target, "flow target")
        _require(self.query, "flow query")
        _choice(self.mode, MODES, "flow mode")
        object.__setattr__(self, "inputs", tuple(dict.fromkeys(self.inputs)))
        object.__setattr__(self, "conf", MappingProxyType(dict(self.conf)))

    def with_conf(self, key: str, value: str) -> Flow:
        return replace(self, conf={**self.conf, key: value})


@dataclass(frozen=True)
class Pipeline:
    """Datasets and flows in declaration order, with settings for the whole run."""

    name: str
    datasets: tuple[Dataset, ...] = ()
    flows: tuple[Flow, ...] = ()
    catalog: str | None = None
    database: str | None = None
    conf: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(self.name, "pipeline name")
        object.__setattr__(self, "datasets", tuple(self.datasets))
        object.__setattr__(self, "flows", tuple(self.flows))
        object.__setattr__(self, "conf", MappingProxyType(dict(self.conf)))
        for what, names in (
            ("dataset", [d.name for d in self.datasets]),
            ("flow", [f.name for f in self.flows]),
        ):
            twice = [n for n, count in Counter(names).items() if count > 1]
            if twice:
                raise PipelineError(f"duplicate {what}: {', '.join(twice)}")

    def key(self, name: str) -> str:
        """The form in which names are compared: lower case, with default database and catalog."""
        key = name.lower()
        if key in self._views:
            return key
        for count, default in ((0, self.database), (1, self.catalog)):
            if default and key.count(".") == count:
                key = f"{default.lower()}.{key}"
        return key

    @cached_property
    def _views(self) -> frozenset[str]:
        """Temporary views, which belong to no database."""
        return frozenset(d.name.lower() for d in self.datasets if d.kind == TEMPORARY_VIEW and "." not in d.name)

    @cached_property
    def _by_key(self) -> dict[str, Dataset]:
        return {self.key(d.name): d for d in reversed(self.datasets)}

    def dataset(self, name: str) -> Dataset | None:
        return self._by_key.get(self.key(name))

    def writers(self) -> dict[str, list[Flow]]:
        found: dict[str, list[Flow]] = {self.key(d.name): [] for d in self.datasets}
        for flow in self.flows:
            found.setdefault(self.key(flow.target), []).append(flow)
        return found

    def problems(self) -> list[str]:
        """The same rules as ``millrace.plans.checks``, for one pipeline held in memory."""
        writers = self.writers()
        declared = {self.key(d.name) for d in self.datasets}
        found = [
            f"flow {f.name!r} writes undeclared dataset {f.target!r}"
            for f in self.flows
            if self.key(f.target) not in declared
        ]
        kinds: dict[str, str] = {}
        for d in self.datasets:
            first = kinds.setdefault(self.key(d.name), d.kind)
            if first != d.kind:
                found.append(f"dataset {d.name!r} is declared as {first} and as {d.kind}")
            if d.kind == TEMPORARY_VIEW and "." in d.name:
                found.append(f"temporary view {d.name!r} has a qualified name")
        for d in self.datasets:
            flows = writers[self.key(d.name)]
            if not flows:
                found.append(f"no flow writes dataset {d.name!r}")
            if d.kind == TABLE:
                continue
            if len(flows) > 1:
                found.append(f"{d.kind} {d.name!r} has {len(flows)} writers instead of one")
            found += [f"{d.kind} {d.name!r} cannot be filled by once flow {f.name!r}" for f in flows if f.mode == ONCE]
        return found
