"""touchline: panel analytics for sports-fixture style data, written for Spark DataFrames."""
