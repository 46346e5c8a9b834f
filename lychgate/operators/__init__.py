"""operators of the gate."""
