"""Jobs that run the library's operators on files: each module has a command line, a config file beside it and a function that takes a session."""
