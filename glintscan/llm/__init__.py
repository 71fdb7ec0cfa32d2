"""Operators for training-data pipelines: texts, tokens, web archives, vectors.

Tasks get the functions of this package by value, so executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
