"""The questions.

questions   q01–q61 as functions of Roles and the questions' literals
variants    alternative readings with a different result set (v03–v56)
catalog     the registry of all of them and the literals used on warehouse data
oracle_sql  the same questions as SQL: DuckDB oracle statements and Spark SQL forms
common      shared tie-break orders
"""
