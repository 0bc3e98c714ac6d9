"""kmerloom: k-mer analytics and read correction on Spark DataFrames."""
