from __future__ import annotations

from dataclasses import FrozenInstanceError

import pytest

from millrace import Dataset, Flow, Pipeline, PipelineError
from millrace.run import stages


def q(context):
    return None


def test_required_fields_fail_fast():
    for bad in (
        lambda: Dataset("", "table"),
        lambda: Dataset(None, "table"),
        lambda: Flow("", "t", q),
        lambda: Flow("f", "", q),
        lambda: Flow("f", "t", None),
        lambda: Pipeline(""),
    ):
        with pytest.raises(PipelineError, match="is required"):
            bad()


def test_unknown_choices_are_refused():
    with pytest.raises(PipelineError, match="dataset kind must be one of"):
        Dataset("d", "streaming_table")
    with pytest.raises(PipelineError, match="flow mode must be one of"):
        Flow("f", "t", q, mode="continuous")
    with pytest.raises(PipelineError, match="dataset write must be one of"):
        Dataset("d", "table", write="merge")


def test_definitions_cannot_be_changed():
    conf = {"a": "1"}
    flow = Flow("f", "t", q, ("x", "y", "x"), conf=conf)
    conf["a"] = "2"
    assert flow.conf["a"] == "1"
    assert flow.inputs == ("x", "y")
    with pytest.raises(TypeError):
        flow.conf["a"] = "3"
    with pytest.raises(FrozenInstanceError):
        flow.name = "other"
    changed = flow.with_conf("b", "2")
    assert dict(flow.conf) == {"a": "1"} and dict(changed.conf) == {"a": "1", "b": "2"}


def test_persisted_means_everything_but_temporary_views():
    assert Dataset("t", "table").persisted and Dataset("m", "materialized_view").persisted
    assert not Dataset("v", "temporary_view").persisted


def test_declaration_order_is_kept_and_duplicates_are_refused():
    datasets = [Dataset("b", "table"), Dataset("a", "table")]
    flows = [Flow("z", "b", q), Flow("y", "a", q)]
    pipeline = Pipeline("p", datasets, flows)
    datasets.append(Dataset("c", "table"))
    assert [d.name for d in pipeline.datasets] == ["b", "a"]
    assert [f.name for f in pipeline.flows] == ["z", "y"]
    with pytest.raises(PipelineError, match="duplicate dataset: a"):
        Pipeline("p", [Dataset("a", "table"), Dataset("a", "table")])
    with pytest.raises(PipelineError, match="duplicate flow: f"):
        Pipeline("p", [Dataset("a", "table")], [Flow("f", "a", q), Flow("f", "a", q)])


def names(pipeline):
    return [[f.name for f in wave] for wave in stages(pipeline)]


def test_chain_runs_in_three_waves():
    pipeline = Pipeline(
        "p",
        [Dataset("orders_source", "table"), Dataset("orders_clean", "temporary_view"), Dataset("daily", "materialized_view")],
        [
            Flow("daily", "daily", q, ("orders_clean",)),
            Flow("clean", "orders_clean", q, ("orders_source", "outside.table")),
            Flow("seed", "orders_source", q),
        ],
    )
    assert pipeline.problems() == []
    assert names(pipeline) == [["seed"], ["clean"], ["daily"]]


def test_a_reader_waits_for_the_slowest_writer():
    pipeline = Pipeline(
        "p",
        [Dataset(n, "table") for n in ("a", "b", "sink", "out")],
        [
            Flow("one", "sink", q),
            Flow("two", "sink", q, ("b",)),
            Flow("b", "b", q, ("a",)),
            Flow("a", "a", q),
            Flow("out", "out", q, ("sink",)),
        ],
    )
    assert names(pipeline) == [["one", "a"], ["b"], ["two"], ["out"]]


def test_cycles_and_self_reading_flows_are_refused():
    ring = Pipeline("p", [Dataset("a", "table"), Dataset("b", "table")], [Flow("fa", "a", q, ("b",)), Flow("fb", "b", q, ("a",))])
    own = Pipeline("p", [Dataset("a", "table")], [Flow("fa", "a", q, ("a",))])
    for pipeline in (ring, own):
        with pytest.raises(PipelineError, match="cycle"):
            names(pipeline)


def test_names_are_compared_as_spark_compares_them():
    pipeline = Pipeline(
        "p",
        [Dataset("Orders", "table"), Dataset("shop.Daily", "table")],
        [Flow("d", "SHOP.daily", q, ("ORDERS",)), Flow("o", "shop.orders", q)],
        database="Shop",
    )
    assert pipeline.problems() == []
    assert names(pipeline) == [["o"], ["d"]]


def test_default_catalog_completes_names():
    pipeline = Pipeline(
        "p",
        [Dataset("orders", "table"), Dataset("cat.shop.daily", "table"), Dataset("seed", "temporary_view")],
        [Flow("d", "shop.daily", q, ("Cat.Shop.Orders",)), Flow("o", "orders", q, ("SEED",)), Flow("s", "seed", q)],
        catalog="cat",
        database="shop",
    )
    assert pipeline.problems() == []
    assert names(pipeline) == [["s"], ["o"], ["d"]]


def test_every_rule_is_reported():
    pipeline = Pipeline(
        "p",
        [Dataset("idle", "table"), Dataset("view", "materialized_view"), Dataset("temp", "temporary_view")],
        [Flow("a", "view", q), Flow("b", "view", q), Flow("once", "temp", q, mode="once"), Flow("lost", "nowhere", q)],
    )
    found = "\n".join(pipeline.problems())
    assert "flow 'lost' writes undeclared dataset 'nowhere'" in found
    assert "no flow writes dataset 'idle'" in found
    assert "materialized_view 'view' has 2 writers" in found
    assert "temporary_view 'temp' cannot be filled by once flow 'once'" in found
