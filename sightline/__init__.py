"""Search-visibility analytics on Spark: DataFrame in, DataFrame out."""
