"""Matrix, graph and statistics operators over Spark DataFrames."""
