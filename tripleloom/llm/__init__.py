"""Operators that prepare training corpora for language models.

Thirteen operators, one module each, plus ``queries`` which binds them to the
tables of a data folder.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
