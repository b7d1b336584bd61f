"""Spark-native analytics over collections of machine-generated source functions.

Every operator takes and returns DataFrames; nothing here keeps state outside
the tables that it is handed.
"""
