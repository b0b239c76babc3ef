"""Registered queries: every module of this folder holds QUERIES and SQL."""
