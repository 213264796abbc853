"""Tables come as DataFrames from any of Spark's sources; here is what the engine itself writes and reads again."""
