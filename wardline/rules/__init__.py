"""Rule tables as plain data; every operator takes its table as a parameter."""
