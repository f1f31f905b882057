"""Operators for training data: language, repeats, quality, mixing, counting and packing of documents."""
