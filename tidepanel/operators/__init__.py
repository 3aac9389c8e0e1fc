"""Relational operators on panels: reshaping, windows, profiles, cleaning, splits and scaling."""
