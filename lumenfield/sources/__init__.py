"""Tables that the operators read."""
