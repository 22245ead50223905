"""Operators: DataFrame -> DataFrame functions grouped by concern."""
