"""Column functions: geometry, fits, robust statistics, colour and formatting."""
