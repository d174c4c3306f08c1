"""tuneframe: instruction-tuning data work as Spark DataFrame operators.

Every public operator takes DataFrames (or a path) plus column names and
returns a DataFrame; nothing is collected to the driver except bounded
statistics (quantile cut points, a scalar maximum).
"""

import sys as _sys

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python functions handed to Spark (pandas UDFs, ``mapInPandas``) are
    pickled with their code, so executors need no installed copy of this
    package. (Shipping a zip with ``--py-files`` works as well.)"""
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(_sys.modules[__name__])


_ship_by_value()
