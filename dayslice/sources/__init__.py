"""Typed readers, file intake, writers and catalog tables."""
