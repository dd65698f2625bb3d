"""Conversion-assurance analytics as Spark jobs.

functions: column expressions.  sources: readers and writers.  operators: DataFrame to DataFrame transforms.
plans: registered queries with their SQL twins.  streaming: the same transforms on streams.
"""
