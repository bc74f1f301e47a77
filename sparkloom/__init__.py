"""Language-model work inside Spark DataFrames: inference, structured outputs, tagging, vectors, search and costs."""
