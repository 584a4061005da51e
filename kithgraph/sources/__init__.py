"""Where networks come from and go to: files and published data."""
