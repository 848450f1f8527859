"""tagmill functions."""
