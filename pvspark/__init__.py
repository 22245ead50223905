"""pvspark: hourly solar-energy analytics expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` built from Column
expressions, range-frame windows, joins and ``pyspark.ml`` stages, so that
Catalyst plans whole jobs and the work is partitioned by Spark.
"""

__version__ = "0.1.0"
