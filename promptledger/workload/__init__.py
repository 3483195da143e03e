"""The registered queries over the test tables, with their SQL equivalents."""
