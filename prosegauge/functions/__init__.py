"""See the package text."""
