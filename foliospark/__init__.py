"""Document-structure analytics on Spark: section trees, page ranges, granular units and tree search over DataFrames."""
