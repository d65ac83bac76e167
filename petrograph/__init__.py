"""petrograph: oil-market event / price / graph analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame; nothing is
collected to the driver.  The registry in ``petrograph.plans.registry``
maps each query name to its Spark builder and its DuckDB oracle SQL.

Functions that run inside Spark tasks are pickled by value, so executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])
