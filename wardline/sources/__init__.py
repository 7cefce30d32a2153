"""Reading report files and tables, and writing results."""
