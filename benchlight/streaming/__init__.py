"""The acquisition chain over micro-batches."""
