"""Where the messages of a topic come from."""
