"""The same operators over files as they arrive."""
