"""Tables and event sources."""
