"""claimscope: provider-billing anomaly analysis on Spark DataFrames."""

from claimscope.session import build_session

__all__ = ["build_session"]
