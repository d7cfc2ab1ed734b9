"""Queries made of the operators, and the SQL that checks them."""
