"""Labels for the Spark UI."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def job_group(spark: SparkSession, name: str, description: str = "") -> Iterator[None]:
    """Jobs started inside carry this group; the one before comes back after."""
    context = spark.sparkContext
    before = [(k, context.getLocalProperty(k)) for k in ("spark.jobGroup.id", "spark.job.description")]
    context.setJobGroup(name, description or name)
    try:
        yield
    finally:
        for k, v in before:
            context.setLocalProperty(k, v)
