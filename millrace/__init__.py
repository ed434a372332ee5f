"""millrace: change-analysis operators over Spark DataFrames."""
