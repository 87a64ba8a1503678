"""Row counts of a plan's steps, taken in the same pass as the step itself.

``StepCounts.on`` puts an observation on a frame; the counts come with the first action that
runs the plan, at no extra scan. ``table`` gives them as rows afterwards. An observed frame is
read by one action only: write the result (``sink``, ``write_scratch``) and go on from there,
or the counts are those of whichever action came first. A step that the optimiser can skip
(the other side of a join is empty) counts nothing and is reported as 0.

Observe in a session of its own (``counting_session``): once a session has observed anything,
Spark 4.1 can no longer serialise it, and MLlib's transformers, which carry their session,
fail in it. Frames are read in that session and handed over as files.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StepCounts:
    def __init__(self):
        self.steps: list[tuple[str, list[str], Observation]] = []

    def on(self, df: DataFrame, step: str, **flags: Column) -> DataFrame:
        """``df``, counting its rows and those for which each flag is true."""
        seen = Observation(f"{step}-{uuid.uuid4().hex}")
        self.steps.append((step, ["rows", *flags], seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(f).alias(name) for name, f in flags.items()])

    def rows(self) -> list[tuple[str, str, int]]:
        """(step, count, value), after an action has run."""
        return [(step, name, int(got.get(name) or 0)) for step, names, seen in self.steps for got in [_taken(seen)] for name in names]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "step string, count string, value long")


def counting_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` (same context, catalog cache and settings) to observe in."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        own.conf.set(key, spark.conf.get(key))
    return own


def _taken(seen: Observation) -> dict:
    try:
        return seen.get
    except Py4JJavaError:       # the step was optimised away, and its observation has no row
        return {}


def null_key(*cols: str) -> Column:
    """True where a key column is NULL: such a row joins nothing."""
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out
