"""Column functions: text, time, network and access-mask expressions."""
