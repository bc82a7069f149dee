"""Operators for large training corpora; nothing else in the library imports this subpackage.

Functions of this subpackage that run in tasks travel with the task, so executors need numpy and
pyarrow but no installed copy of it.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
