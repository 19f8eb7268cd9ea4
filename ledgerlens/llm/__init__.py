"""Training-data operators: deduplication, packing, tokenization, quality,
personal data and chat formatting, each as Spark jobs."""
