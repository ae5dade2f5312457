"""skillgauge: Spark DataFrame operators for analysing evaluation results at scale.

Every public function takes and returns DataFrames or Columns, so callers compose one
lazy plan and leave the physical strategy to Spark.
"""

import sys

from pyspark.cloudpickle import cloudpickle as _cloudpickle

# Python tasks get the few helper functions of this package with the job, so executors
# need no installed copy of it.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
