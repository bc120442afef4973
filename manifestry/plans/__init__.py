"""Query plans over the tables of the driver contract."""
