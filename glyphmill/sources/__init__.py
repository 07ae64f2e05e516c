"""Reading and writing: whole files, JSON lines in three degrees of strictness, saved runs, chat records."""
