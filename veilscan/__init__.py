"""veilscan: Spark-native text-safety and tool-call audit jobs.

Every operator takes and returns DataFrames. The heavy work (regex scans,
validators, joins, windows) is expressed with built-in Spark SQL functions so
that Catalyst keeps it inside whole-stage codegen and partitions it across the
cluster. See README.md for the operator map.
"""

from veilscan.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
