"""Operators for preparing training text; nothing else in the library imports them.

Functions that run inside tasks travel with the task, so that the executors need no
copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
