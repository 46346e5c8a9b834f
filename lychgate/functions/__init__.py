"""functions of the gate."""
