"""End-to-end jobs and experiment sweeps."""
