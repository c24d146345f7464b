"""Table-to-table operators on recordings, features and assignments."""
