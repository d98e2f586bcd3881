"""Part of copse; see README.md."""
