"""See the module list in the README."""
