"""pathfold: GPS track archives as Spark DataFrames.

The central relation is the long *points* table
``(activity_id, seq, ts, lon, lat, ele, hr, cadence, power)`` with a dense,
zero-based ``seq`` per activity.  Everything else (cleaning, summaries,
geometry levels, heat, joins) is a DataFrame transformation of it.
"""

import sys

from pyspark import cloudpickle

# UDFs travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
