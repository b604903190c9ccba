"""tidemark: product analytics on Spark DataFrames.

Ordered and unordered funnels, cohort retention, RFM segmentation, a
data-quality audit and overview figures, each a DataFrame -> DataFrame
operator planned by Catalyst and run by Spark.
"""

from tidemark.operators import *  # noqa: F401,F403
from tidemark.operators import __all__ as _ops

__all__ = list(_ops)
