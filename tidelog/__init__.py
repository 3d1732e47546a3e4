"""Event-log analytics on Spark: DataFrame operators, incremental derived tables and streams."""

import sys

from pyspark import cloudpickle

# functions of this package go to the executors with the plan, so it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
