"""Named end-to-end plans over the test tables."""
