"""From a syntax tree to DataFrames, and how a plan is told."""
