"""Operators for preparing training text at scale; nothing else in the library imports this subpackage.

Functions that run in tasks are shipped by value, so executors need the public libraries but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
