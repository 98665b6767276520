"""Declarative batch pipelines on PySpark: datasets, flows, publishing and lineage."""

from millrace.model import Dataset, Flow, Pipeline, PipelineError
from millrace.run import FlowContext, FlowResult, from_scripts, load_project, plan, report, run

__all__ = [
    "Dataset",
    "Flow",
    "FlowContext",
    "FlowResult",
    "Pipeline",
    "PipelineError",
    "from_scripts",
    "load_project",
    "plan",
    "report",
    "run",
]
