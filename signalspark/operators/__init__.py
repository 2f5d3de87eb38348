"""DataFrame operators on epochs, events and graphs."""
