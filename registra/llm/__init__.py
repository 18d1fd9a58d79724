"""Operators for preparing training text: quality, duplicates, mixing, labels and counts."""
