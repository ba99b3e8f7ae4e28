"""tabloom: build, perturb and score question-answering datasets over tables with Spark."""

import sys

from pyspark import cloudpickle

# Python functions travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
