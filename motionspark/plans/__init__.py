"""Logical plans of the stroke analysis, declared as SQL that Catalyst plans."""
