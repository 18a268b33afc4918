"""Operators for large training collections: similarity, repetition, tokens, packing and splitting."""
