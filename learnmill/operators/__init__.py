"""DataFrame operators of learning analytics."""
