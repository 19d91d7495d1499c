"""corpuskit: Spark-native operators for building text-training corpora and measuring models.

Every public operator is a DataFrame -> DataFrame function. The core work runs as Spark
jobs (joins, aggregations, windows, shuffles); Python runs inside tasks only where the
built-in functions cannot express a rule, and then Arrow-batched.
"""

__version__ = "0.1.0"
