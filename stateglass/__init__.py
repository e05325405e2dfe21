"""State of streaming jobs as ordinary DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from stateglass.operators.diff import diff_snapshots, diff_summary  # noqa: E402
from stateglass.sources.catalog import discover_operators  # noqa: E402
from stateglass.sources.snapshots import discover_snapshots  # noqa: E402
from stateglass.sources.state import read_keyed_state  # noqa: E402

__all__ = [
    "diff_snapshots",
    "diff_summary",
    "discover_operators",
    "discover_snapshots",
    "read_keyed_state",
]
