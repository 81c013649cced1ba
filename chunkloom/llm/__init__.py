"""Training-data operators: language, duplicates, leakage, tokens, pages, privacy and quality."""
