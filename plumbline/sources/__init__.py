"""Reading inputs, and keeping metric values in files and tables."""
