"""Tenant data workbench: cleaning, profiling, search and analytics as Spark jobs."""
