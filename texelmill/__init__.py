"""texelmill - texture and asset analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# task functions travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
