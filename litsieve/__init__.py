"""Evidence-synthesis analytics on Spark: composable ``DataFrame -> DataFrame`` operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
