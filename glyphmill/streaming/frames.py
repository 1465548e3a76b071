"""Live frames: a stateful rolling latency over the last samples of each camera."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.workers import ship

SIZE = 200
FRAME = "frame_id long, ts timestamp, camera string, seconds double, text string, score double"
_OUT = "camera string, frame_id long, ts timestamp, seconds double, mean_ms double, fps double"


def frames(spark: SparkSession, folder: str, per_trigger: int = 1, schema: str = FRAME) -> DataFrame:
    """Frames as files arrive; per_trigger paces the stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def skip_first(stream: DataFrame, count: int) -> DataFrame:
    return stream.where(F.col("frame_id") >= count)


def drop_low(stream: DataFrame, score: float = 0.5) -> DataFrame:
    """Only texts that are shown."""
    return stream.where(F.col("score") >= score)


def rolling_latency(stream: DataFrame, size: int = SIZE) -> DataFrame:
    """Each sample with the mean of the last `size` of its camera, itself included, in ms, and its frame rate.

    The state of a camera is its last size - 1 samples. Samples of one trigger are taken by ts, then frame_id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "frame_id"], kind="stable")
        values = pd.Series(kept + rows["seconds"].tolist(), dtype="float64")
        mean = values.rolling(size, min_periods=1).mean().to_numpy()[len(kept) :] * 1000
        state.update((values.tolist()[-(size - 1) :] if size > 1 else [],))
        yield pd.DataFrame({"camera": key[0], "frame_id": rows["frame_id"], "ts": rows["ts"], "seconds": rows["seconds"], "mean_ms": mean, "fps": [1000 / m if m > 0 else None for m in mean]})

    ship(stream.sparkSession)
    return stream.groupBy("camera").applyInPandasWithState(step, _OUT, "last array<double>", "append", GroupStateTimeout.NoTimeout)


def to_memory(stream: DataFrame, name: str, checkpoint: str):
    """Run a stream over what is there and stop; the rows are in table `name`."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def serve(stream: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, until: Callable[[], bool], every: float = 0.5, pace: str | None = None) -> StreamingQuery:
    """Run a live stream: each trigger's rows go to `show`; it stops when `until` says so, when it is interrupted, or when it ends by itself.

    pace: time between triggers, as soon as possible unless given. Errors of the stream are raised.
    """
    writer = stream.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=pace) if pace else writer).start()
    try:
        while not until() and not query.awaitTermination(every):
            pass
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()
    return query
