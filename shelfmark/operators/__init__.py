"""Operators: functions from DataFrames and a policy to DataFrames."""
