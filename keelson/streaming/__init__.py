"""The same operators on streaming frames."""
