"""Live scoring with keyed state and stream-side queries."""
