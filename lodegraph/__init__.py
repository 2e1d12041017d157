"""A property-graph query engine on PySpark DataFrames."""
