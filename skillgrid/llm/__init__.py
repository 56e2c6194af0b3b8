"""Operators for preparing language-model training text, on Spark.

Nothing outside this subpackage imports it.  Common rules of all operators:

* a null text counts as the empty text;
* every input row is a document, also when ids repeat or are null;
* extra input columns pass through where an operator returns documents; an
  output column of an operator replaces an input column of the same name.
"""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
