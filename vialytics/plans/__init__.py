"""plans of the traffic analytics engine."""
