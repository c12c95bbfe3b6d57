"""Bidirected sequence graphs as four Spark tables, with set-in/set-out operators."""
