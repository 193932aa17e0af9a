"""Column functions over messages, codes, patterns, links and requests."""
