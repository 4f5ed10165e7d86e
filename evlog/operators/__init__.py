"""Operators over DataFrames of events and views."""
