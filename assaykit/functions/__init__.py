"""Column functions: from columns to columns, all inside code generation."""
