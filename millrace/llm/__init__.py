"""Text operators for language model training data."""
