"""Column functions: from columns to columns, in the JVM, usable in any select, filter or aggregate."""
