"""End-to-end jobs, composed of sources, functions and operators."""
