"""Mail-threat analytics and corpus preparation on Spark DataFrames."""
