"""Reading and writing databases and predictions."""
