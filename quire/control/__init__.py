"""Control plane: settings, identities, retries and file names, all on the driver."""
