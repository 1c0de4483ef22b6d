"""Spark-native search, selection and reporting over time-aligned transcripts."""
