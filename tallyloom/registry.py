"""Registered queries and the SQL they are held against."""

from tallyloom.plans import inventory, queries, written

QUERIES = {**queries.QUERIES, **inventory.QUERIES, **written.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **inventory.ORACLE_SQL, **written.ORACLE_SQL}
