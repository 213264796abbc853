"""Operators for preparing large text corpora on Spark.

Each operator is a function from DataFrames to DataFrames in a module of its
own; `queries` binds them to the tables of a data folder.
"""
