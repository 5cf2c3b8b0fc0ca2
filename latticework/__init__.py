"""Evidence-annotated relational queries on Spark DataFrames."""
