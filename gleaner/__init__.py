"""Knowledge retrieval and governance on Spark DataFrames."""
