"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import in_shape
from ..operators.aggregates import segment_summary
from ..operators.labels import reassign
from . import adapters as ad
from . import basics, files, labelling, spatial  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Points in a box get a new instance; the segments are then summarised."""
    picked = ad.points(spark, folder).filter(in_shape(basics.BOX))
    edited = reassign(ad.labels(spark, folder), picked, None, 3).labels
    return segment_summary(edited).orderBy(F.desc("n_points"), "instance_id")
