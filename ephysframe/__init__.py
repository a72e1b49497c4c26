"""ephysframe: Spark DataFrame operators over electrophysiology recording metadata.

Every public operator takes Spark DataFrames and returns a lazy DataFrame.
Nothing is collected to the driver inside an operator; callers decide when
to execute.
"""

from ephysframe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
