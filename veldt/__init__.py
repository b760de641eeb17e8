"""A numeric analytics engine on PySpark: matrices, sparse matrices and tensors as lazy DataFrames."""
