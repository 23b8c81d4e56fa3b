"""Composite operators: scores, backtest, portfolio, reports and dataset jobs."""
