"""Pluggable producers of findings: anything that makes a table of findings from a session and a run."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Run
from ..schemas import FINDINGS

log = logging.getLogger(__name__)

Producer = Callable[[SparkSession, Run], DataFrame]


@dataclass
class Produced:
    """Findings of all producers, with `producer` and `source_seq`, the place of the producer; and what those that failed have said."""

    findings: DataFrame
    errors: dict[str, str]


def conforming(rows: DataFrame) -> DataFrame:
    """The columns of findings, in their types; those that a producer leaves out are null, further ones go. Without file, line or severity it is no table of findings."""
    missing = {"file", "line", "severity"} - set(rows.columns)
    if missing:
        raise ValueError(f"findings need {', '.join(sorted(missing))}")
    fields = [x.split(" ") for x in FINDINGS.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields])


def produced(spark: SparkSession, run: Run, producers: dict[str, Producer]) -> Produced:
    """The findings of all producers one after another. A producer that raises is recorded and the others go on; errors of its own jobs come when its rows are read."""
    errors: dict[str, str] = {}
    out = spark.createDataFrame([], FINDINGS).withColumns({"producer": F.lit(""), "source_seq": F.lit(0)})
    for place, (name, producer) in enumerate(producers.items()):
        try:
            rows = conforming(producer(spark, run))
        except Exception as e:  # a stage that fails leaves an empty batch
            errors[name] = f"{type(e).__name__}: {e}"
            log.warning("producer %s failed: %s", name, errors[name])
            continue
        out = out.unionByName(rows.withColumns({"producer": F.lit(name), "source_seq": F.lit(place)}))
    return Produced(out, errors)
