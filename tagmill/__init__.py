"""tagmill: analytics over annotated text, written as Spark DataFrame plans."""
