"""Operators for preparing training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# tasks carry these functions by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
