"""graphloom.streaming."""
