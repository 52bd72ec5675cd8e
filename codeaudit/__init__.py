"""codeaudit — security findings over fleets of repositories, as Spark DataFrames.

Every detector is a function ``DataFrame -> DataFrame[Finding]``; rule sets are
small constant tables; the findings algebra (dedupe, baseline, policy, scores,
grades, gates, exports) is plain Spark SQL over the ``findings`` relation.
"""

from codeaudit.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
