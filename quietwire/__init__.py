"""quietwire: anomaly analytics for network packets, written for Spark."""

import sys

from pyspark import cloudpickle

# Ship the small task-side helpers by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
