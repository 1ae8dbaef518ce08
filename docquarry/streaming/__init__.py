"""The same refresh as a stream of page drops."""
