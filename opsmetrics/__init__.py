"""Operations analytics over collected telemetry tables, as Spark DataFrames."""
