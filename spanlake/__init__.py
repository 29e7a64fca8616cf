"""spanlake: Spark-native operators for code-span question-answering benchmarks.

Every operator is a DataFrame-in / DataFrame-out function (usable with
``df.transform``) or a ``Column`` expression built from Spark SQL built-ins.
Python workers are used only where a user-supplied model or client is called.
"""

from spanlake.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
__version__ = "0.1.0"
