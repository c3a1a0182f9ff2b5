"""Many-model training, registration, lookup and scoring on Spark DataFrames."""
