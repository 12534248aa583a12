"""Training-data operators: deduplication, scans, archives, decontamination, token output, mixing."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
