"""What the registered queries are compared with: the same results in DuckDB SQL, and file round trips."""
