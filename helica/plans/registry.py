"""All queries of the core, and their SQL."""

from helica.plans import genomic_queries, genomic_sql, problem_queries, problem_sql

QUERIES = {**problem_queries.QUERIES, **genomic_queries.QUERIES}
SQL = {**problem_sql.SQL, **genomic_sql.SQL}
