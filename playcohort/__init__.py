"""Listener cohort analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from playcohort.session import build_session, configure, release, scratch_dir

# The few functions that run inside tasks travel with the job, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure", "release", "scratch_dir"]
