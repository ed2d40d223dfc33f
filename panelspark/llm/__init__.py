"""Operators for preparing training data at scale, each a DataFrame -> DataFrame function."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors carry their module with them, so nothing has to be installed there.
register_pickle_by_value(sys.modules[__name__])
