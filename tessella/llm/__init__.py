"""Text and vector operators for training data.  Nothing outside imports this package."""
