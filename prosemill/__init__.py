"""Measuring and comparing text collections on Spark.

functions: columns from columns; operators: DataFrames from DataFrames;
sources: readers and writers; streaming: the incremental forms; plans: whole
jobs and the registered queries.
"""
