"""Test-data adapter and the independent DuckDB SQL used as the correctness oracle."""
