"""DuckDB SQL that answers every registered query independently of the Spark plans."""
