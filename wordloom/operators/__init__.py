"""Relational operators over lexicons, n-grams, suggestions and histories."""
