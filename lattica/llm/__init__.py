"""Training-data operators: mixing, deduplication, filtering and scoring of a documents table.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns a
DataFrame; model fitting happens on bounded, documented samples, everything else covers all rows.
"""
