"""gaugeline: panels, prediction intervals and decisions on Spark DataFrames."""
