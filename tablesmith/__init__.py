"""tablesmith: profile, chart, select features and train models on large tables with Spark.

Every operator takes and returns Spark DataFrames; nothing is pulled through the driver
except schema metadata, a handful of scalars (bin edges, label lists) and fitted models.
"""

from tablesmith.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
