"""Registered queries with their oracle SQL, one module per operator family."""
