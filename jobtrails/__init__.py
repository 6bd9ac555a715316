"""jobtrails: Spark-native career-path analytics.

Every operator takes and returns a DataFrame; the heavy lifting is left to
Catalyst (joins, aggregates, windows) and, for the iterative models only, to
Arrow-batched pandas functions that Spark partitions and shuffles.
"""

from jobtrails.session import get_spark, checkpoint_dir  # noqa: F401
