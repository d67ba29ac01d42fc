"""DataFrame operators on alignment records."""
