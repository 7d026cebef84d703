"""Where tables come from and where intermediate rows are kept."""
