"""eigenloom: embedding geometry on Spark.

A table of keys plus a float-vector column is the unit of data. Heavy row work
is DataFrame plans; small d x d algebra runs on the driver and is broadcast
back. Sub-packages: ``sources``, ``functions``, ``operators``, ``plans``,
``streaming``.
"""

__version__ = "0.1.0"
