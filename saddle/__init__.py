"""Graph embeddings on Spark. Functions that run in tasks travel with the task, so executors need no installed copy of the package."""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
