"""Named queries over the driver's tables."""
