"""Jobs with a command line; each is a function that takes a session."""
