"""Query plans over tables."""
