"""Knowledge-retrieval and learner analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quarrymind.session import build_session  # noqa: E402

__all__ = ["build_session"]
