"""Column expressions shared by the operators."""
from tidemill.functions.text import fields, running, split_tokens, tokens, utf16_length

__all__ = ["fields", "running", "split_tokens", "tokens", "utf16_length"]
