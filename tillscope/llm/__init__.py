"""Operators for preparing training text: one module each, and ``queries`` that applies them."""

import sys

from pyspark import cloudpickle

# What the tasks run travels with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
