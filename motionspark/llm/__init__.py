"""Operators for building training corpora: dedup, tokenizing, search, scanning, mixing and scoring."""
