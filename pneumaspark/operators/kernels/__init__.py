"""NumPy kernels for whole-signal operators that no window expression can state."""
