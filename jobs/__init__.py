"""Jobs that can be run by themselves: each a function of a session and plain paths, with a command line and a small configuration file."""
