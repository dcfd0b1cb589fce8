"""operators of the traffic analytics engine."""
