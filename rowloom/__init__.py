"""rowloom: wide per-entity feature tables on Spark.

One main table with one row per entity, several one-to-many history tables,
fitted encoders and scalers, and a scorer, all written as DataFrame
transformations. Nothing here runs a job unless its docstring says so.
"""
