"""The normal distribution function, which Spark lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: v if v != v else 0.5 * math.erfc(-v / math.sqrt(2)))
