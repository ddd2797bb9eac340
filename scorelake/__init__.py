"""PySpark-native operators for score-transcription tables and training-data corpora.

Functions that run inside Python workers are pickled by value, so executors
need no copy of this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
