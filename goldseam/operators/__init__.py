"""Operators: functions from DataFrames to DataFrames, lazy unless they say otherwise."""
