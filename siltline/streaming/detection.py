"""The stateless detectors on streams of files or texts, and new findings across runs by the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltline.operators import detect
from siltline.operators import findings as O


def stream_line_findings(files: DataFrame, keys: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """Line rules on a stream of (keys, language, text): the same plan as in a batch, without state."""
    return O.classify(detect.line_findings(detect.to_lines(files, keys), keys))


def severity_windows(found: DataFrame, at: str = "at", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings per severity and time window, with a watermark for late ones."""
    return found.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), "severity").agg(F.count("*").alias("n"), F.max("confidence").alias("most"))


def only_new(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Stream of findings that the (static) baseline doesn't know."""
    known = baseline.select(F.lower("fingerprint").alias("_fp"), F.lit(True).alias("_known")).where("_fp is not null").distinct()
    keyed = found.withColumn("_fp", O.fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("title")))
    return keyed.join(known, "_fp", "left").where("_known is null").drop("_fp", "_known")


def append_findings(found: DataFrame, place: str, checkpoints: str) -> StreamingQuery:
    """Findings written as Parquet, exactly once per input."""
    return found.writeStream.outputMode("append").format("parquet").option("path", place).option("checkpointLocation", checkpoints).start()
