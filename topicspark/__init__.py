"""Topic modelling over large text collections, expressed as Spark tables and jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The Arrow kernels travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
