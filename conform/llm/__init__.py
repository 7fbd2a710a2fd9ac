"""Operators that prepare training text: archives, repeats, personal data, overlap with tests, mixtures, language."""
