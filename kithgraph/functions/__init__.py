"""Expressions, stored tables and components that operators share."""
