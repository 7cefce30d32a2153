"""Operators: functions from DataFrame to DataFrame with column names and rule tables as parameters."""
