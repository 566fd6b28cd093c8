"""Price-feed and service-log analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Tasks get the library's functions by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from pricelake.session import build_session, scratch_path, shared_dir  # noqa: E402

__all__ = ["build_session", "scratch_path", "shared_dir"]
__version__ = "0.1.0"
