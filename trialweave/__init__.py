"""Sequential new-user trials from longitudinal health records, on Spark DataFrames."""
