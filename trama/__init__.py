"""Link analysis and entity resolution over registries, as DataFrame operators."""

__version__ = "0.1.0"
