"""Operators put together: simulating, approving, executing and rolling back a migration."""
