"""hemerion: transcript and document analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from hemerion.session import ensure_checkpoint_dir, get_session, materialize, table

__all__ = ["ensure_checkpoint_dir", "get_session", "materialize", "table"]

# Functions for Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
