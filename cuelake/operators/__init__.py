"""Operators on DataFrames: ranking, intervals, sequences, retrieval, selection and mutation."""
