"""The study chain and the registered queries."""
