"""Citation analytics on Spark: DataFrame in, DataFrame out."""
