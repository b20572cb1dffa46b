"""Training-data pipeline operators: ten jobs over documents, labels, benchmark
items and conversations.  Nothing else in the library imports this package."""
