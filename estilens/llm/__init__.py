"""Operators that prepare text for the training of language models."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that run them: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
