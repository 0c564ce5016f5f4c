"""binscope: exploratory data analysis and factor analysis on Spark DataFrames.

Every operator takes and returns a ``pyspark.sql.DataFrame``; the heavy work
(distinct counts, quantiles, per-bin statistics, rank correlations) runs as
Spark aggregations over all columns at once. Only small per-factor summaries
(at most a few hundred rows per factor) are ever handled in pandas, and then
inside Spark tasks via ``applyInPandas``.
"""

from binscope.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
