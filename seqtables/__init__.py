"""Table operators for protein-sequence analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package: its few task functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
