"""Part of codeloom."""
