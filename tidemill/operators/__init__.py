"""Relational operators: functions from DataFrames and parameters to DataFrames."""
