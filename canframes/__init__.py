"""canframes: Spark-native preparation, splitting, windowing, scoring and evaluation
of labelled vehicle-bus frames.

Every public operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a ``fit`` that returns a small parameter object collected from
a one-row aggregate, the same contract ``pyspark.ml`` uses.
"""

from canframes.schema import FEATURES, SEED

__all__ = ["FEATURES", "SEED"]
