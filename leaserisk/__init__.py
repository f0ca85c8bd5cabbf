"""leaserisk: lease-renewal risk analytics as Spark DataFrame plans.

Sub-packages
------------
sources    readers/writers and the driver-table -> lease-domain adapter
functions  Column builders (scalars, tiers, named measures)
operators  features, scoring, prep, evaluation, warehouse, reports, retention, ML
plans      the registered query catalogue and its DuckDB oracle SQL
streaming  Structured Streaming monitors with batch twins
"""

from leaserisk.config import AS_OF  # noqa: F401
from leaserisk.session import get_session, checkpoint_dir  # noqa: F401
