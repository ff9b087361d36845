"""driftwise: event-stream pattern discovery on Spark DataFrames and Structured Streaming.

Events from files and message feeds get one envelope, pass a configurable chain
of DataFrame operators (validation, normalisation, time bars, moving averages,
RSI), run drift / anomaly / cluster-change detectors per key, and land as raw,
clean and pattern tables that can be queried, explained and rated.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Python workers are sent by value, so that
# executors need neither the package on their path nor the driver's folder.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
