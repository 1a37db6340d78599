"""Plans over the given tables: the task lens and the registered queries."""
