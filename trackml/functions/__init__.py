"""Column expressions shared by operators, registered queries and checks."""
