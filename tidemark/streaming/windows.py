"""Streaming forms: files as a stream, tumbling windows, a running drift alarm per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.stats import bocpd_step


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream; the checkpoint of the query takes the place of a ledger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tumbling(events: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, value) per tumbling window; events later than the watermark are dropped by the stream. Over a
    finished input the closed windows equal those of the batch."""
    w = events.withColumn(at, F.col(at).cast("timestamp"))
    w = w.withWatermark(at, late) if w.isStreaming else w
    g = w.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))
    return g.select(F.col("w.start").alias("start"), by, "n", "value")


def running_alarm(buckets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(entity, start, p_change, alarm) for each new bucket (entity, start, decks, field_decks) of a stream. The state
    of an entity is the posterior of its run length, so all points count as in the batch; buckets must come in order
    per entity."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *post = state.get if state.exists else (0, [1.0], [1.0], [1.0])
        post = tuple(np.array(x) for x in post)
        new = pd.concat(list(pdfs)).sort_values("start")
        out = []
        for start, decks, field in zip(new["start"], new["decks"], new["field_decks"]):
            post, seen = bocpd_step(post, int(decks), int(field)), seen + 1
            p = float(post[0][:2].sum())
            out.append((key[0], start, p, p >= threshold and seen > 2))
        state.update((seen, *(x.tolist() for x in post)))
        yield pd.DataFrame(out, columns=["entity", "start", "p_change", "alarm"])

    return buckets.groupBy("entity").applyInPandasWithState(step, "entity string, start date, p_change double, alarm boolean", "seen long, run array<double>, al array<double>, be array<double>", "append", GroupStateTimeout.NoTimeout)
