"""Change analysis for tables on Spark: snapshots, diffs, profiles, links and hypotheses."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
