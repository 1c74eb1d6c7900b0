"""Operators for training-data pipelines. Nothing else in the library imports this package.

Columns that an operator carries along may have any names but those that begin with two underscores, which are its own.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions sent to Python workers carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
