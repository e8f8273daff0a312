"""Part of the tidewatch library."""
