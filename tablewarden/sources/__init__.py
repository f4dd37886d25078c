"""Reading and writing tables, snapshots, issues and run logs."""
