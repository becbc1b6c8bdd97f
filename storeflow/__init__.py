"""Retail demand analytics on Spark: cleaning, features, forecast evaluation, POS totals."""

from storeflow.spec import SalesSpec

__all__ = ["SalesSpec"]
