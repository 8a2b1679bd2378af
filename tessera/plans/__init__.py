"""The dialect's front end: tokens, syntax, names, types."""
