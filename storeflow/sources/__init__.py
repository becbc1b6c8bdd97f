"""Reading and writing of files and catalog tables."""
