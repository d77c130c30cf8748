"""Operators for text corpora: language, chat, decontamination, licences, duplicates, URLs, tokens.

Python steps of these operators are sent to the workers by value, so a worker needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
