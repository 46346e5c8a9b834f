"""sources of the gate."""
