"""shockspark — demand-shock analytics for travel and hospitality on Spark.

Every operator is a function ``f(DataFrame, ..., params) -> DataFrame`` built from
native Spark SQL expressions; none of them runs an action.  Sub-packages:

* ``sources``   – readers of the landing formats and the derived test fact tables
* ``operators`` – cleaning, features, shock metrics, KPIs, travel funnel, series, forecasts
* ``functions`` – reusable column expressions (safe division, clipping, scores, bins)
* ``plans``     – end-to-end batch plans and the query catalogue
* ``streaming`` – incremental daily fact with Structured Streaming
"""

__version__ = "0.1.0"
