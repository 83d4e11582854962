"""Training-data operators: quality, URL rules, dedup, sharding, language, tokens, near-dedup, LM scores, packing.

Functions of this package travel to the executors by value, so nothing has to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
