"""regstat: case-registry incidence analytics as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
family of DataFrames); nothing is collected to the driver except bounded,
size-checked lookup sides (see ``regstat.functions.sizing``).
"""

from regstat.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
