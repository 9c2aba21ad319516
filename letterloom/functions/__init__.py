"""Column functions: DataFrame expressions without any action."""
