"""Analytics of sequential generation traces, and of the corpora behind them, on Spark."""
