"""Text of queries: tokens, syntax tree, column names."""
