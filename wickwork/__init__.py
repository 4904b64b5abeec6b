"""Candle, signal and combination-backtest analytics on Spark DataFrames."""
