"""mensura: panel time-series analytics on PySpark.

Every operator takes and returns DataFrames keyed by ``(series_id, period)``
and is partitioned by series, so one job serves one series or millions.
"""

from mensura.session import get_session, scratch_dir

KEYS = ["series_id"]
ORDER = "period"

__all__ = ["get_session", "scratch_dir", "KEYS", "ORDER"]
