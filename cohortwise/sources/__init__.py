"""Reading, writing and refreshing tables."""
