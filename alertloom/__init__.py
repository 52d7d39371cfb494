"""alertloom: security-event window features, rule/model scoring and alert triage on Spark.

Every operator takes and returns a ``pyspark.sql.DataFrame``; nothing is collected to the
driver except bounded model artefacts (tree node tables, fitted statistics).
"""

import sys as _sys

from alertloom.session import checkpoint_dir, get_spark

from pyspark import cloudpickle as _cp

# Task closures carry the library's helpers by value, so executors need not have it installed.
_cp.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
