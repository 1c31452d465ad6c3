"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Functions that run on the
executors are pickled by value, so a cluster needs no installed copy of it.
"""

from .. import ship_by_value  # noqa: F401
