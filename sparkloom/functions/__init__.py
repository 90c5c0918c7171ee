"""Column functions: text, JSON, numbers, policies and scores."""
