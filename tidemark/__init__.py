"""Analytics over marker-synchronised event streams, as DataFrame jobs."""
