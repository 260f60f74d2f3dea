"""voxlab: Spark-native screening and severity analytics over feature tables.

Every operator is a function ``DataFrame -> DataFrame`` (or a column
expression) built from the DataFrame / SQL API so that Catalyst plans it and
the work spreads over the cluster.  Sub-packages:

* ``sources``   -- scans and sinks (CSV / JSON / Parquet, model persistence,
                   prediction log) and the stand-in adapters for the test tables
* ``functions`` -- scalar column functions (guards, clipping, bands, formats)
* ``operators`` -- projections, joins, aggregates, ordered-series measures,
                   splits, oversampling, learners, scoring and explanation
* ``plans``     -- the registered end-to-end queries and their SQL oracles
* ``streaming`` -- Structured Streaming scoring and running tallies
"""

__version__ = "0.1.0"
