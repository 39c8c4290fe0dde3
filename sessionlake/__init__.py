"""DataFrame operators for measuring coding-agent work from event logs at scale."""
