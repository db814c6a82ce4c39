"""Scalar building blocks as SQL text: text helpers, checksums, normalisation."""
