"""Where payloads come from, what is in them, and where results go."""
