"""locusflow: multilocus diploid genotype analytics on Spark DataFrames."""
