"""Row operators over transaction tables."""
