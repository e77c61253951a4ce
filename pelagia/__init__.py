"""pelagia: gridded ocean fields on Spark DataFrames."""
