"""Seasonal forecasting and drift response over many series, as Spark jobs."""

import sys

from pyspark import cloudpickle

from tidemark.spec import DatasetSpec, FeatureSpec, GPSpec, OnlineSpec, SeriesSpec

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DatasetSpec", "FeatureSpec", "GPSpec", "OnlineSpec", "SeriesSpec"]
