"""Column functions: text cleaning, roles, tasks, hashing, numeric schedules."""
