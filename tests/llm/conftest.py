"""The session and fixtures of the folder above serve here too."""
