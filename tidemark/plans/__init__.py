"""Whole plans: showcase, backtest, daily report."""
