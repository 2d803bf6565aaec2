"""DataFrame-to-DataFrame operators, each over all subjects at once."""
