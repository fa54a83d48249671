"""Column functions: text, labels, durations, classification rules."""
