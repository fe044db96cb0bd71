"""siltline: code-security analytics and data preparation on Spark DataFrames."""
