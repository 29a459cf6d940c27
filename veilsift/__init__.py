"""veilsift: credential-exposure analytics on PySpark DataFrames."""
