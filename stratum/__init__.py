"""stratum: speech-and-text corpus preparation as Spark DataFrame operators.

Every public operator has the form ``op(df, *, column names, params) -> DataFrame``
and only builds a lazy plan; nothing is collected unless the docstring says so
(and then only bounded, proven-small tables such as a codebook).
"""

from stratum.session import get_spark, checkpoint_dir, table

__all__ = ["get_spark", "checkpoint_dir", "table"]
