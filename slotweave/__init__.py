"""slotweave: product-placement data operators on Spark DataFrames."""
