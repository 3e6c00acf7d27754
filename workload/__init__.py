"""The measured and checked queries: every operator over whole tables, and its SQL."""
