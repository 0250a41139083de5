"""delayspark: a Spark-native engine for transit delay and open-data catalogue jobs.

Every operator is a lazy ``DataFrame -> DataFrame`` function; see
``delayspark.registry`` for the named queries and their SQL oracles.
"""

__version__ = "0.1.0"
