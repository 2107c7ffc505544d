"""Text analytics and boolean retrieval on Spark DataFrames."""
