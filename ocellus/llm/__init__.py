"""Operators of a training-data pipeline. Optional: nothing else in ocellus imports this subpackage."""
