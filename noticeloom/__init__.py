"""noticeloom: a Spark-native engine for legal-notice extraction, querying and reconciliation."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
