"""Lexical retrieval, evidence graphs and evaluation over DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"


def ship_by_value(module_name: str) -> None:
    """Have functions of this module travel with the task, so that executors need no installed copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
