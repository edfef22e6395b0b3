"""Training-data operators. Nothing else in parcelflow imports this subpackage."""
