"""Operators of a training-data pipeline: cleaning, de-duplication, search and packing of text and vectors.

Nothing else in the library imports this subpackage. The code that runs inside
tasks travels with the job, so executors need pyspark, pyarrow, numpy and the
libraries a module names, but not this package.
"""

import sys

from affinara.shipping import by_value

by_value(sys.modules[__name__])
