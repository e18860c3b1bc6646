"""Operators for preparing training text: rules, deduplication, filtering, tokens, packing, chats."""
