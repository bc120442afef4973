"""Trade-document verification over Spark DataFrames."""
