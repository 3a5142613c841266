"""Prepare and evaluate text corpora with plain DataFrame transformations."""
