"""Relational operators over strings, count tables and estimates."""
