"""Sources: the driver-table adapter and readers / writers / layers."""
