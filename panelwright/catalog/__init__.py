"""Registered queries over the driver tables, each with equivalent SQL where SQL can say it."""
