"""How a whole audit is planned: shared passes, then rules."""
