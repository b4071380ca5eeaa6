"""Where files, functions, changes and outside reports come from."""
