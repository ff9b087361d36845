"""Structured Streaming forms of the operators.

* ``stream_bars``: tumbling / sliding event-time bars with a watermark (append
  mode emits each window once the watermark passes its end; later rows are
  dropped and counted by Spark as ``numRowsDroppedByWatermark``).
* ``stream_features`` / ``stream_normalize``: row-frame operators need a per-key
  history, which streaming windows cannot express; each key keeps its last rows
  in ``applyInPandasWithState`` (a bounded ring buffer), rows inside a micro-batch
  are sorted by the order columns. Same results as the batch operators when rows
  arrive in order.
* ``stream_adwin``: ADWIN buckets per (key, field) as streaming state.
* ``run_stages``: raw -> clean -> patterns tables from one stream (foreachBatch).
"""

from .rolling import stream_adwin, stream_features, stream_normalize
from .run import run_stages, stream_bars

__all__ = ["run_stages", "stream_adwin", "stream_bars", "stream_features", "stream_normalize"]
