"""Operators over series and candidates as DataFrame transformations."""
