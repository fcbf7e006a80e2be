"""All queries of the subpackage and the SQL of those that SQL can express."""

from . import queries_free, queries_native

QUERIES = {**queries_native.QUERIES, **queries_free.QUERIES}
SQL = {**queries_native.SQL, **queries_free.SQL}
