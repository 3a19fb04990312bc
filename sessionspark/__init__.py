"""Session analytics on Spark: extraction, lifecycle, strike accounting, behaviour patterns and audio turns."""
