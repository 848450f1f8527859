"""tagmill operators."""
