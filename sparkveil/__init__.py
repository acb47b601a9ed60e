"""De-identification of conversational text and its analytics as DataFrame operators."""

__version__ = "0.1.0"
