"""Query language: text to syntax tree to DataFrame plan."""
