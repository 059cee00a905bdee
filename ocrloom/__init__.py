"""Text recognition as a dataflow of Spark DataFrames."""
