"""Refuse results that cannot be published as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.model import PipelineError


def require_batch(df: DataFrame | None, flow: str) -> DataFrame:
    """Return ``df`` unless it is missing or streaming.

    Registering a streaming DataFrame as a temporary view succeeds silently in
    Spark, so this has to run before any publishing call.
    """
    if df is None:
        raise PipelineError(f"flow {flow!r} returned no DataFrame")
    if df.isStreaming:
        raise PipelineError(f"flow {flow!r} returned a streaming DataFrame; only batch flows can be published")
    return df
