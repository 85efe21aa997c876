"""quarry: columnar scans, zone skipping and codec transforms as ordinary Spark DataFrames."""
