"""Column functions: paths, text, stemming, vectors."""
