"""Stage drivers for spark-submit."""
