"""Files that hold matrices and vectors."""
