"""Reading notes and fixtures, writing indexes and exports."""
