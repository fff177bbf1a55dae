"""Operators: functions from DataFrames to DataFrames. Rows are those of helixframe.schema."""
