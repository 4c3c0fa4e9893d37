"""Whole runs: lazy plans plus the few writes that close them."""
