"""graphloom.sources."""
