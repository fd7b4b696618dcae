"""Reading landed tables, JSON lines, XML and database tables; keyed upserts."""
