"""Training-data operators over the documents, pages, labels, benchmark and conversations tables."""
