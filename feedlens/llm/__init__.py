"""Operators for building training corpora, and their registered queries.

Nothing else in the library imports this package.  Functions that run inside
tasks are pickled by value, so executors need only the public libraries.
"""

import sys

from pyspark import cloudpickle

from feedlens import session

for _module in (sys.modules[__name__], session):
    cloudpickle.register_pickle_by_value(_module)
