"""Where the six role tables come from.

roles         the Roles container, required columns, view registration
workshop_csv  the workshop CSV files (both editions) with explicit schemas
role_store    roles written to / read from Parquet folders
warehouse     the roles mapped onto order-entry warehouse tables, and their one-time persistence
"""
