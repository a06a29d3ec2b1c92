"""Column expressions over contacts, names, dates and texts."""
