"""lodestone: labelled-property-graph analytics expressed as Spark DataFrames."""
