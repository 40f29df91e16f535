"""Group-fairness audit operators for decision tables and decision streams on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is collected except
fitted state of bounded size (quantile edges, category names, model coefficients).
"""

import sys

from pyspark import cloudpickle

# Python functions used in tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
