"""Building blocks that take and return DataFrames."""
