"""Discovery over tables that grow by streams."""
