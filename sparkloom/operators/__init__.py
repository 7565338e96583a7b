"""Operators: DataFrames in, DataFrames out. Importing a module registers its queries."""
