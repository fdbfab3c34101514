"""DataFrame operators for messy personal and operational records at scale."""
