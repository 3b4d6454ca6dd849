"""Every operator as a query on the driver tables, next to the SQL it must agree with."""
