"""Column expressions shared by operators, jobs and reports."""
