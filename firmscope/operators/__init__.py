"""DataFrame -> DataFrame operators over registry tables."""
