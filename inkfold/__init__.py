"""Document analytics on Spark: Markdown and HTML in DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Executors get the library's functions with each task, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
