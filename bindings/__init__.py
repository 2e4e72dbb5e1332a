"""The analyses run on the driver's order tables, which stand in for enrolments and spells."""
