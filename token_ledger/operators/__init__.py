"""DataFrame operators on usage rows."""
