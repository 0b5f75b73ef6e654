"""Course-knowledge analytics and corpus preparation on Spark DataFrames."""
