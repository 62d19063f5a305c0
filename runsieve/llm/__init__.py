"""Training-data operators.  Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import runsieve

# Worker functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(runsieve)
