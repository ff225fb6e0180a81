"""Spark-native data-science operators: functions from DataFrames to DataFrames."""
