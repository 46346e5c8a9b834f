"""plans of the gate."""
