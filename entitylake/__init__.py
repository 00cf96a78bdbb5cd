"""Entity lake: entity-centred text analytics on Spark DataFrames."""
