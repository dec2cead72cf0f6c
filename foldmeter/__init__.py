"""Compare classifiers on labelled tables, as Spark jobs.

Tables go in, result tables come out: every operator takes and returns
DataFrames.  Fitted models keep only class- and feature-sized parameters.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
