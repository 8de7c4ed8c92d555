"""photowarden: photosensitive-safety analytics on Spark."""
