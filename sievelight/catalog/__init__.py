"""Rules that ship with the library."""
