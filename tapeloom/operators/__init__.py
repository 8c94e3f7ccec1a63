"""Relational, ordered and point-in-time operators over DataFrames."""
