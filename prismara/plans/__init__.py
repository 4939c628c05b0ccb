"""Query plans over the driver tables and the end-to-end flows."""
