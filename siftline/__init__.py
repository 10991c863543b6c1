"""siftline: retrieval, ranking and evaluation queries over text corpora, on Spark DataFrames."""
