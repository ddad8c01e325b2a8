"""The analyses: functions from tables to a DataFrame."""
