"""PySpark-native analytics for free-text feedback and text corpora.

Functions that run on executors are sent with the job, so the package need only be
importable on the driver.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
