"""Property graphs from nested records and text, as DataFrames."""
