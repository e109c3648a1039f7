"""Sources: workspaces, configuration, rule engines and message texts."""
