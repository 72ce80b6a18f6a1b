"""Files and catalog tables."""
