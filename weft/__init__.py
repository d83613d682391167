"""weft: graph analytics over Spark DataFrames.

A property graph is two DataFrames (nodes and edges); every operator is a function from graphs and
parameters to DataFrames.  Python code that runs on executors travels with its task, so a cluster
needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
