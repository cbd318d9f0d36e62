"""DataFrame -> DataFrame operators. Nothing here collects data to the driver."""
