"""Operators for training data and for search, percentiles and clusters at scale; nothing outside imports this."""
