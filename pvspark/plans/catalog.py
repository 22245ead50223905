"""All registered queries; importing a query module registers it."""

from __future__ import annotations

from pvspark.plans import q_history  # noqa: F401
from pvspark.plans import q_profile  # noqa: F401
from pvspark.plans import q_quality  # noqa: F401
from pvspark.plans import q_validation  # noqa: F401
from pvspark.plans import q_align  # noqa: F401
from pvspark.plans import q_features  # noqa: F401
from pvspark.plans import q_metrics  # noqa: F401
from pvspark.plans import q_charts  # noqa: F401
from pvspark.plans import q_models  # noqa: F401
from pvspark.plans import q_io  # noqa: F401
from pvspark.plans import q_tuning  # noqa: F401
from pvspark.plans import q_records  # noqa: F401
from pvspark.plans.registry import ORACLE, QUERIES  # noqa: F401

flagship = q_history.flagship
