"""Running metrics of an operation log: as a stream with state for each family, and of a whole table without one task for a family."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.metrics import is_violation

#: Operations of a run, within which a batch query ranks.
RUN = 1000
ROW = "event_id long, family string, n long, bytes long, violations long, longest double, total_ms double"
STATE = "n long, bytes long, violations long, longest double, total_ms double"


def _counted(log: DataFrame) -> DataFrame:
    return log.select("event_id", "family", F.col("size").cast("long").alias("size"), F.col("elapsed_ms").cast("double").alias("elapsed_ms"), is_violation().cast("long").alias("violation"))


def running_stream(log: DataFrame) -> DataFrame:
    """A stream of log rows -> after each operation: the operations of its family so far, their bytes, violations, longest and total time.

    The state of a family is five numbers and outlives batches and restarts.
    Rows count in the order in which they come, within a batch by event_id; a
    late row counts when it comes, and rows that were given out stay as they
    are.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        n, size, violations, longest, total = state.get if state.exists else (0, 0, 0, float("-inf"), 0.0)
        out = pd.DataFrame({
            "event_id": own["event_id"], "family": key[0], "n": n + np.arange(1, len(own) + 1), "bytes": size + own["size"].cumsum(), "violations": violations + own["violation"].cumsum(),
            "longest": np.maximum(own["elapsed_ms"].cummax(), longest), "total_ms": total + own["elapsed_ms"].cumsum(),
        })
        last = out.iloc[-1]
        state.update((int(last["n"]), int(last["bytes"]), int(last["violations"]), float(last["longest"]), float(last["total_ms"])))
        yield out

    return _counted(log).groupBy("family").applyInPandasWithState(update, ROW, STATE, "append", GroupStateTimeout.NoTimeout)


def running_table(log: DataFrame, run: int = RUN) -> DataFrame:
    """The same of a whole table, in the order of event_id: totals of runs of ids are few and are summed up first, rows within their run."""
    placed = _counted(log).withColumn("run", F.floor(F.col("event_id") / run))
    sums = placed.groupBy("family", "run").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("violation").alias("violations"), F.max("elapsed_ms").alias("longest"), F.sum("elapsed_ms").alias("total_ms"))
    before = Window.partitionBy("family").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("family", "run", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "bytes", "violations", "total_ms")), F.max("longest").over(before).alias("_longest"))
    inner = Window.partitionBy("family", "run").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = {"n": F.count("*").over(inner), "bytes": F.sum("size").over(inner), "violations": F.sum("violation").over(inner), "total_ms": F.sum("elapsed_ms").over(inner)}
    ranked = placed.withColumns({**own, "longest": F.max("elapsed_ms").over(inner)}).join(sums, ["family", "run"])
    return ranked.select("event_id", "family", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("n", "bytes", "violations")), F.greatest("longest", "_longest").alias("longest"), (F.col("total_ms") + F.col("_total_ms")).alias("total_ms"))
