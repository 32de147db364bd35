"""Map analytics of query results, as Spark plans."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with them: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
