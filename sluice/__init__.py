"""sluice: moving and guarding tabular data as Spark DataFrames."""
