"""Column builders: geometry, seismology, encodings, calibration."""
