"""Training-data operators on Spark. Nothing else in the library imports this package.

Tasks carry the code of this package with them, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
