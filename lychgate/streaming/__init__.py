"""streaming of the gate."""
