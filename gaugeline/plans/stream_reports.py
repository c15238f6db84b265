"""Reports that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.session import shared_path
from ..streaming import adaptive as st
from . import base as b
from .panel_reports import ORACLES, report


@report()
def streamed_aci(spark, sf_dir):
    rows = b.rows(spark, sf_dir).filter("split <> 'train'").withColumn("low", F.col("occ")).withColumn("high", F.col("occ"))
    return st.replay(spark, rows, shared_path(spark, "stream"), alpha=b.ALPHA, horizon=b.HORIZON, gamma=b.GAMMA)


ORACLES["streamed_aci"] = ORACLES["aci_stream"]  # a stream and a batch fold agree
