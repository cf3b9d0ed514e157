"""Column functions: text cleaning and splitting, Korean quantities."""
