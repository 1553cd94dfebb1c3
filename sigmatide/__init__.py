"""Volatility analytics for price series, as DataFrame operators keyed by ticker."""

from sigmatide.market import Market

__all__ = ["Market"]
