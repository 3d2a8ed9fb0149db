"""evalspark: evaluation analytics on Spark."""

# Functions shipped to Python workers (pandas UDFs, mapInPandas) are pickled by
# value, so executors need no installed copy of this package.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
