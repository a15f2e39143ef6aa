"""The registered queries over the shared tables, each with its SQL."""
