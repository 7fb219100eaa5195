"""Part of ocellus."""
