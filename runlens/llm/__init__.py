"""Operators that prepare training text: quality, chat, pages, neighbours, duplicates, personal data, mixing, packing."""
