"""codeplane: analytics over source-code repositories and their texts on Spark DataFrames."""
