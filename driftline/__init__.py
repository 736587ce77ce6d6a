"""Analytics over large tables of irregular, revisioned, per-object time series.

Satellite orbital-element histories are the main use. Every operator takes and returns
DataFrames and treats all objects in one job.
"""

import sys

from pyspark import cloudpickle

# Python tasks carry the functions they call, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
