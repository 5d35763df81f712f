"""Registered queries: an operator applied to the derived tables, and the SQL it must agree with."""
