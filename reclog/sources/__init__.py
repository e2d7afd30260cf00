"""Tables that become records."""
