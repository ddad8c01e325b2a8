"""Operators that prepare training data.  Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this subpackage by value, so that executors need no
# copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
