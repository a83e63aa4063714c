"""cytogrid: spatial-omics analytics as PySpark DataFrame operators.

Cells, transcripts, polygons, label rasters and graphs are long-form
DataFrames; every operator returns a lazily planned DataFrame.
"""
__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# executors need no installed copy: functions of this package travel by value
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
