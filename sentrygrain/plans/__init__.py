"""The batch pipeline and the registered queries."""
